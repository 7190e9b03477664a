"""Preparation of training text: deduplication, packing, sharding, mixing, filters, archives.

Nothing outside this subpackage imports it. ``registry`` lists the queries.
"""
