"""Operators that prepare large text and record collections: matching, cleaning, tokenising, packing, sharing."""
