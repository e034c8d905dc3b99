"""Scratch tables go with their scope."""

import os

import pytest

from pulsegrid.llm import common
from pulsegrid.llm.repair import repair


def scratch(spark):
    folder = common.shared_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("pulsegrid-")}


def test_a_scope_removes_what_was_made_inside_it(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    kept = common.stored(turns)
    before = scratch(spark)
    with common.scratch_scope(spark):
        edits, figures = repair(turns)
        edits.write.parquet(f"{tmp_path}/edits")
        assert scratch(spark) > before
    assert scratch(spark) == before and kept.count() == 2 and spark.read.parquet(f"{tmp_path}/edits").count() == 2
    with pytest.raises(ValueError), common.scratch_scope(spark):
        common.stored(turns)
        raise ValueError
    assert scratch(spark) == before
