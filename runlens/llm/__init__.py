"""Operators of a training-data pipeline and the queries that apply them.

``registry.QUERIES`` and ``registry.ORACLE_SQL`` hold what the driver runs.
Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
