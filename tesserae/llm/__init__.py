"""Operators of a training-data pipeline: one module per operator.

Every operator takes and returns DataFrames.  ``registry`` lists the queries
that apply them to whole tables.
"""
