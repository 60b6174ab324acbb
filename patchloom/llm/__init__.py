"""Training-data operators: packing, cleaning, search, extraction, scoring, tokenising, deduplication, PII.

Nothing else in the library imports this subpackage.
"""
