"""Readers: recordings, curves, JSON documents and file inventories as DataFrames."""
