"""Operators for preparing training text: classifiers, deduplication, decontamination, secrets, tokens, shards."""
