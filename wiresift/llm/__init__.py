"""Operators of a training-data pipeline: filters, de-duplication, scoring, packing and output."""
