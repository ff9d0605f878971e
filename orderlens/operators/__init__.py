"""Building blocks shared by the analyses.

Every block takes and returns DataFrames. Group keys with a missing value are
dropped before grouping, as the source semantics ask.
"""
