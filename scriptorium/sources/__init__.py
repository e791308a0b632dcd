"""Readers and writers over Spark's data sources. Paths may be in any store that Spark reaches."""
