import numpy as np
import pytest

from tessella.operators import profile as B
from tessella.plans import planner
from tessella.sources.series import SCHEMA, from_array
from tessella.streaming.append import GrowingProfile
from tests.test_profile import walk


def frame(p):
    got = p.orderBy("series_id", "i").toPandas()
    return np.stack(got["p"]), np.stack(got["j"]), got["left_j"].to_numpy(), got["right_j"].to_numpy()


@pytest.mark.parametrize(("k", "limit"), [(1, 1 << 20), (3, 0)])
def test_updates_equal_one_join(spark, tmp_path, monkeypatch, k, limit):
    monkeypatch.setattr(B, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(B, "strip_blocks", lambda *_: 2)
    monkeypatch.setattr(planner, "MAX_BLOCK", 32)
    monkeypatch.setattr(planner, "MIN_BLOCK", 32)
    t = walk(170, 1)
    t[60] = np.nan
    grow = GrowingProfile(spark, str(tmp_path), 10, k)
    assert grow.block == 32
    table = from_array(spark, t)
    for lo, hi in ((0, 70), (70, 71), (71, 130), (130, 170)):
        grow.update(table.where(f"i >= {lo} AND i < {hi}"))
        grow = GrowingProfile(spark, str(tmp_path), 10, k)  # opened again each time
    for x, y in zip(frame(grow.profile()), frame(B.wide(table, 10, k=k))):
        assert np.array_equal(x, y)


def test_follows_a_stream(spark, tmp_path):
    t = from_array(spark, walk(120, 2))
    source = str(tmp_path / "in")
    grow = GrowingProfile(spark, str(tmp_path / "state"), 12)
    for lo, hi in ((0, 50), (50, 120)):
        t.where(f"i >= {lo} AND i < {hi}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = grow.follow(stream, str(tmp_path / "checkpoint"), availableNow=True)
        assert query.awaitTermination(120) and query.exception() is None
    for x, y in zip(frame(grow.profile()), frame(B.wide(t, 12))):
        assert np.array_equal(x, y)


def test_a_replayed_batch_and_a_broken_update_change_nothing(spark, tmp_path):
    t = from_array(spark, walk(100, 3))
    GrowingProfile(spark, str(tmp_path), 9).update(t.where("i < 60"), 0)
    again = GrowingProfile(spark, str(tmp_path), 9)
    assert (again.version, again.batch) == (1, 0)
    again.update(t.where("i < 60"), 0)
    assert again.version == 1 and again.series.count() == 60
    t.where("i >= 60 AND i < 70").write.parquet(f"{tmp_path}/series/2")  # written, not logged
    again = GrowingProfile(spark, str(tmp_path), 9)
    assert again.series.count() == 60
    again.update(t.where("i >= 60"), 1)
    for x, y in zip(frame(GrowingProfile(spark, str(tmp_path), 9).profile()), frame(B.wide(t, 9))):
        assert np.array_equal(x, y)
