"""Corpus jobs over message texts: models, near copies, repeats, token counts and packing."""
