"""Training-data operators: dedup, decontamination, tokenisation, quality, URL and HTML filters.

Nothing outside this subpackage imports it.
"""
