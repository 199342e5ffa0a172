"""Acoustic measurement analytics as Spark jobs."""
