"""Training-data operators: quality, tokens, dedup, search, BPE, HTML, mixing, rules, secrets, phrases, pieces, runs.

Each module holds one operator with a general interface; ``queries`` registers
the thin ``opN_*`` queries that derive digests from those operators.
"""
