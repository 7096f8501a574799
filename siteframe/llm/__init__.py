"""Operators for training-data pipelines: filtering, extraction, archives, mixing, near-duplicates and scoring."""
