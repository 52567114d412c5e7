"""Operators of a training-data pipeline."""
