"""Every registered query against its SQL form, and the ordered ones again with streams cut into blocks."""

import pytest
from check import compare, connect

import __spark_entry__ as entry_module
import framewell.ordered

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()

BLOCKED = [
    "select_rows",
    "scene_score",
    "trim",
    "frame_step",
    "resample_fps",
    "retime_accumulated",
    "dejudder",
    "fill_gaps",
    "rebatch",
    "interleave",
    "sync_join",
    "mix_streams",
    "dark_intervals",
    "dark_frames",
    "silence_intervals",
    "trim_silence",
    "drop_one_per_cycle",
    "representative_frame",
    "crop_bounds",
    "frame_signal_stats",
    "stream_checksum",
    "keep_results",
    "sliding_histogram",
    "command_events",
    "channel_delay",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        assert compare(got, con.execute(ORACLES[name]).df()) == ""
    else:
        assert len(got)


@pytest.mark.parametrize("name", BLOCKED)
def test_query_in_blocks(spark, con, sf_dir, name, monkeypatch):
    monkeypatch.setattr(framewell.ordered, "BLOCK_ROWS", 20)
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert compare(got, con.execute(ORACLES[name]).df()) == ""


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["token", "n", "mean_delay_ms", "max_delay_ms"]
    assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
