"""Training-corpus operators: sharding, near-dedup, tokenization, decontamination,
language ID, quality rules, URL filters, archives, token counts and secret scans.

Nothing outside this subpackage imports it; ``queries`` holds its registered queries.
"""
