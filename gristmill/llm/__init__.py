"""Training-data operators: near-dedup, mixing, scoring, tokens, sharding, search and packing.

Nothing outside this folder imports it; ``queries.py`` names the queries that the
driver entry adds when the folder is present.
"""
