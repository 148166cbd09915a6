"""Operators for preparing training text: duplicates, language, licences, secrets, tokens and packing."""
