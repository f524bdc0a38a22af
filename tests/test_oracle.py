"""Every registered query against its oracle on the smallest tables."""

from __future__ import annotations

import pytest

from repoaudit.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    text, ok = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SMALL)
    assert ok, text


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
