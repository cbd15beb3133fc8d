"""Source intelligence over DataFrames: extraction, search, resolution, budgets, grading and statistics."""
