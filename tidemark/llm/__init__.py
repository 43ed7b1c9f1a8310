"""Training-data operators: dedup, language ID, tokens, packing, sharding, exact search.

Nothing else in the package imports this subpackage.
"""
