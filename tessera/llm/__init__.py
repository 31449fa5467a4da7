"""Operators of a training-data pipeline, their queries and their oracle SQL.

Nothing else in the library imports this subpackage; ``registry`` lists its queries.
"""
