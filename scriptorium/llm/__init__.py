"""Operators of a training-data pipeline: ten stages over documents and pages."""
