"""Training-data operators: dedup, rules, decontamination, tokens, sharding, secrets.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
"""
