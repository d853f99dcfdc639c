"""Training-data operators: de-duplication, filtering, extraction, packing, mixing and output.

Nothing outside this package imports it. `registry` holds the queries.
"""
