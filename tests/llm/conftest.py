from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with columns that clash."""

    def build(rows):
        rows = [(*r, *[None] * (4 - len(r)), 1, "x", 0.5, [1]) for r in rows]
        return spark.createDataFrame(
            rows,
            "doc_id long, text string, lang string, source string, n int, sig string, score double, line array<int>",
        )

    return build


ODD_TEXTS = [None, "", " \t\n ", "\n\n", "a", "a b", "é", "\x0b\x0c", "日本語", "x" * 5000, "!!! ???", "a  b   c "]


@pytest.fixture(scope="session")
def odd():
    """Rows of odd texts, each of them twice."""
    return [(i, t, "en" if i % 3 else None, "s" if i % 2 else None) for i, t in enumerate(ODD_TEXTS * 2)]
