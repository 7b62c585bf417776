"""Training-data operators: deduplication, quality, language, safety, tokens, packing and archives.

Nothing else in the library imports this subpackage.
"""
