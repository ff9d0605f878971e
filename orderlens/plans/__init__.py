"""The analyses: each function takes the ``sales`` table and returns one result table."""
