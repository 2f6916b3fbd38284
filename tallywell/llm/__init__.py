"""Operators for training-data pipelines: packing, duplicates, decontamination, toxicity, licences, quotes, URLs."""
