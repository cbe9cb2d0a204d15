from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__ as entry


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_never_names_the_subpackage():
    for p in (Path(entry.__file__).parent / "lodestone").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|lodestone\.llm", p.read_text()), p
