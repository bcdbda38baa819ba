"""Preparation of training data: deduplication, filtering, extraction, formatting, sharding and encoding."""
