"""Operators of a training-data pipeline: deduplication, decontamination, scoring, packing and sharding."""
