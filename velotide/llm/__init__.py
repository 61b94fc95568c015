"""Operators over corpora of text: mixing, deduplication, extraction, scoring, sharding."""
