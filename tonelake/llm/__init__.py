"""Operators for large training-data pipelines, each a Spark job of its own.

Nothing else in the library imports this subpackage; ``registry`` lists its
queries and the SQL they are held against.
"""
