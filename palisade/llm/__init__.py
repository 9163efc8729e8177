"""Operators for preparing training data: secrets, archives, mixing, quality, near-duplicates, lines, URLs, personal data, decontamination."""
