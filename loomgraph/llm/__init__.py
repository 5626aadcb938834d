"""Operators of a training-data pipeline: dedup, tokens, filters, extraction, scans."""
