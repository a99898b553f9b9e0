"""Training-data operators (packing, dedup, search, scans, mixing, sharding).

Nothing else in the package imports this subpackage.
"""
