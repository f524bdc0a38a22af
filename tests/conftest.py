from __future__ import annotations

import pytest

from repoaudit.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def make_files(spark):
    """``files`` rows from {repo: {path: text}}; an empty repository is not expressible as a row."""

    def build(trees: dict[str, dict[str, str]]):
        rows = [(r, p, t, len(t.encode())) for r, tree in trees.items() for p, t in tree.items()]
        return spark.createDataFrame(rows, "repo_id string, path string, text string, size_bytes long")

    return build
