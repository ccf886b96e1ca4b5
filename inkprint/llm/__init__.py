"""Operators of a training-data pipeline: extraction, scoring, tokenisation, filtering, sharding, dedup, mixing, search."""
