"""Operators of a training-data pipeline: dedup, decontamination, mixing, sharding, scoring, archives."""
