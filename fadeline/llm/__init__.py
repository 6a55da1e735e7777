"""Training-data operators: filters, tokenisation, search, deduplication, PII, packing.

Nothing else in the library imports this subpackage.
"""
