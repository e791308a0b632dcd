"""Structured Streaming forms of the incremental operators; each has a batch form with the same rows."""
