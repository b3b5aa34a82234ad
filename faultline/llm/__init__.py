"""Operators for preparing training data: filtering, labelling, deduplication, search, mixing and tokenising."""
