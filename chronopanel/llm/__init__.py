"""Operators of a large training-data pipeline: dedup, decontamination, personal data, scoring, packing, token files, vector search."""
