"""Operations that a large training-data pipeline needs, each on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
