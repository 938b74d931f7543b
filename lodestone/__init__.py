"""A PySpark engine for entity snapshots: immutable exports of nested objects as (entity, path, value) triples."""
