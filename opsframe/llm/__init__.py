"""Operators for preparing training data: privacy, duplicates, quality, chat, mixing, markup, toxicity, tokens."""
