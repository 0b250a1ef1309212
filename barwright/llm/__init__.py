"""Operators for training-data corpora: near duplicates, repeated passages, quality, language, toxicity, packing, archives."""
