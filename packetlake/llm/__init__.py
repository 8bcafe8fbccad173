"""Operators of a training-data pipeline: near duplicates, tokens, toxicity, packing, PII, search, mixing, URL rules."""
