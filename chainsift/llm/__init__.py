"""Training-data operators: joins, dedup, formatting, tokens, filters and classifiers over text tables.

Nothing else in the library imports this subpackage.
"""
