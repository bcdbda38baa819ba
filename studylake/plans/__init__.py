"""Operators composed into whole jobs: ingest, search context, reports."""
