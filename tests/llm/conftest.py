from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """``documents`` rows from (id, text) or (id, text, lang, source), dealt over several partitions."""

    def build(rows, parts: int = 3):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and long texts, repeated rows, repeated ids, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    long_text = "word " * 30_000 + "end."
    rows = [
        (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (3, "other text of the same id"), (None, "no id here"),
        (None, None), (4, long_text), (5, long_text), (6, "\n\n \t\n"), (7, "Ünï çødé 日本語 text\nwith lines", None, None),
    ]
    names = ["doc", "row_key", "row", "score", "hi", "slot", "node", "label", "size", "place", "copies", "features"]
    return make_docs(rows).withColumns({n: F.lit(f"extra {n}") for n in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
