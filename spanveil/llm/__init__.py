"""Training-data operators: scoring, filtering, matching, mixing and sharding.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when it is present.
"""
