"""Streams: index upkeep, event replay, request correlation."""
