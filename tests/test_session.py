"""Intermediate tables: where they go, and that nothing is left of them."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from repoaudit.session import checkpoint_root, release, run_folder, stage


def fake(master: str, folder: str | None):
    conf = SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "/w"}.get(key) or default)
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_folder_is_the_clusters():
    assert checkpoint_root(fake("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert checkpoint_root(fake("local[4]", None)) == "/w/stages"
    with pytest.raises(ValueError):
        checkpoint_root(fake("yarn", None))


def test_stage_and_release(spark):
    rows = stage(spark.range(10).repartition(3), "t")
    assert sorted(r.id for r in rows.collect()) == list(range(10))
    at = run_folder(spark).removeprefix("file:")
    assert os.listdir(at)
    release(spark)
    assert not os.path.exists(at)
