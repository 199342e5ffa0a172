"""Operators over samples, curves, takes and catalogues: DataFrame in, DataFrame out."""
