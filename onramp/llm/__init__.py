"""Training-data pipeline operators (sharding, language ID, BPE, URL filters, mixing,
secret scans, near-duplicates, top-k search, quality rules and quality classifier).

Nothing else in the package imports this subpackage.
"""
