"""Operators of a training-data pipeline: mixing, extraction, decontamination, deduplication, parsing, filtering and scoring."""
