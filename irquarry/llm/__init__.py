"""Operators of a training-data pipeline: packing, scoring, deduplication, sharding, filters, media, mixing, archives."""
