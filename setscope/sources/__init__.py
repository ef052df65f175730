"""Readers and writers: raw tables in, normalised frames out, results to storage."""

from setscope.sources.tables import read_table, test_table
from setscope.sources.memberships import (
    code_dictionary, code_domain, itemsets, memberships, registry, run_stats, sample_rows, subjects)
from setscope.sources.results import read_result, upsert_by_key, write_result

__all__ = [
    "read_table", "test_table", "memberships", "registry", "itemsets", "subjects",
    "code_dictionary", "code_domain", "sample_rows", "run_stats", "write_result", "read_result",
    "upsert_by_key",
]
