"""Queries: bindings of operators to tables, with SQL to hold them against."""

from . import evaluation, executed, grown, kept, memory_text, roundtrip, sqlsurface, texts  # noqa: F401  (registers the queries)
