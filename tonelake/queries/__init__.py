"""Queries over the given tables, each with the SQL it is held against.

The tables stand in for a session's: embeddings are takes of 64 samples whose
label is the source, events are a sample stream, lineitem rows are repeated
measurements, the rest are catalogues.
"""
