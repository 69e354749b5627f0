"""The guard in the entry point hides a missing subpackage, but must not hide a broken one."""

from __future__ import annotations

import importlib
import re


def test_every_operator_and_the_pipeline_are_registered():
    entry = importlib.import_module("__spark_entry__")
    numbers = [int(m[1]) for m in (re.match(r"op(\d+)_", name) for name in entry.queries()) if m]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
