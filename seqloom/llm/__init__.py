"""Operators for preparing training corpora: mixing, extraction, identification, dedup, packing, archives."""
