"""Training-data operators: language id, joins on n-grams, formatting, packing, media, scoring.

Nothing outside this subpackage imports it.
"""
