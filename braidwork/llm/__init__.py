"""Training-data operators: filters, near-duplicate joins, pseudonyms, mixing and packing.

Nothing else in the library imports this subpackage.
"""
