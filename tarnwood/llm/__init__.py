"""Training-data operators: packing, near-duplicates, cleaning, scoring and scanning at corpus scale.

Nothing else in the library imports this subpackage.
"""
