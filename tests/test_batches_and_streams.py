"""Batches that count once, live runs as a stream that is killed and started again, and readers of many careers."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rosterly.operators import playlog
from rosterly.sources import batches, export
from rosterly.streaming import live
from tests.test_indexes import scans

UTC = datetime.timezone.utc


def pairs_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_counts_once(spark, tmp_path):
    path, one = str(tmp_path / "t"), lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    assert batches.read(spark, path, "k long").collect() == [] and batches.entered(spark, path) == []
    one(7, 8).write.parquet(batches.folder(path, 0))  # lost before it was entered
    assert pairs_of(batches.read(spark, path, "k long")) == []
    assert batches.write(one(1, 2), path, 0) and not batches.write(one(9), path, 0) and batches.write(one(3), path, 10)
    assert pairs_of(batches.read(spark, path, "k long")) == [(1,), (2,), (3,)] and batches.entered(spark, path) == [0, 10]
    assert pairs_of(batches.compacted(spark, path, str(tmp_path / "u"), "k long")) == [(1,), (2,), (3,)]
    batches.forget(spark, path, 0)
    assert pairs_of(batches.read(spark, path, "k long")) == [(3,)]


def test_resuming_by_key_takes_each_once(spark, tmp_path):
    path, asked = str(tmp_path / "t"), []

    def fetch(d):
        asked.append(d)
        return d.withColumn("v", F.lit(len(asked)))

    items = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    batches.resume(items(1, 2, 3), "k", fetch, path, "k long, v int", 2)
    items(4).withColumn("v", F.lit(0)).write.parquet(batches.folder(path, 2))  # lost
    got = batches.resume(items(5, 4, 3), "k", fetch, path, "k long, v int", 1)
    assert sorted(r.k for r in got.collect()) == [1, 2, 3, 4, 5] and got.where("v = 0").count() == 0
    assert batches.resume(items(1, 5), "k", fetch, path, "k long, v int").count() == 5


class Killed(Exception):
    pass


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_that_is_killed_and_resumed_equals_the_batch_job(spark, tmp_path, seed):
    rng, rows = random.Random(seed), []
    for user in range(6):
        for day in range(4):
            date = datetime.date(2024, 1, 1 + day)
            for k in range(rng.randint(0, 12)):
                ts = datetime.datetime(2024, 1, 1 + day, rng.randrange(24), 5, tzinfo=UTC)
                rows.append([f"{user}-{day}", user, date, ts, 0, rng.choice(["right"] * 4 + ["wrong", "skip", "hint", "resign"]), rng.randrange(9)])
    rows.sort(key=lambda r: r[3])
    for seq, r in enumerate(rows):
        r[4] = seq
    after_midnight = ["0-0", 0, datetime.date(2024, 1, 1), datetime.datetime(2024, 1, 2, 0, 1, tzinfo=UTC), 10_000, "wrong", 1]
    want = live.settled(spark.createDataFrame(rows, live.EVENT))
    # Parts of random length; within a day the order is random and some rows come twice.
    order = sorted(rows, key=lambda r: (r[2], rng.random()))
    cuts = sorted(rng.sample(range(len(order)), 3))
    parts = [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)])]
    parts[1] += parts[1][:3]
    parts[0].append(after_midnight)
    parts[-1].append(["end", 0, datetime.date(2024, 1, 9), datetime.datetime(2024, 1, 9, 1, tzinfo=UTC), 0, "hint", 0])
    landed, path, progress, kills = str(tmp_path / "in"), str(tmp_path / "runs"), str(tmp_path / "progress"), []

    def kill(number):
        if rng.random() < 0.5 and len(kills) < 3:
            kills.append(number)
            raise Killed

    for part in parts:
        spark.createDataFrame(part, live.EVENT).coalesce(1).write.mode("append").parquet(landed)
        for _ in range(6):
            query = live.settle(spark.readStream.schema(live.EVENT).parquet(landed), path, progress, "1 day", kill)
            try:
                query.awaitTermination()
                break
            except Exception as e:
                assert "Killed" in str(e)
    assert kills
    got = live.runs(spark, path)
    assert pairs_of(got) == pairs_of(want)
    assert pairs_of(live.stats(spark, path)) == pairs_of(playlog.streaks(want.select("user_id", "date", "won")))


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_careers_of_many_members_read_their_shards(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(export, "BROADCAST_IDS", few)
    spells = spark.range(3000).select((F.col("id") % 1500).alias("member_id"), (F.col("id") % 3).alias("team_id"), F.lit(2000).alias("start_year"), F.lit(2001).alias("end_year"), F.lit(1).alias("apps"), F.lit(1).alias("goals"), F.lit(False).alias("loan"), F.col("id").alias("seq"))
    path = str(tmp_path / "c")
    export.write_careers(export.career_shards(spells), path)
    ids = [m for m in range(1500) if m % 128 in (3, 64, 127)] + [99_999 * 128 + 3]
    got = export.read_careers(spark, path, spark.createDataFrame([(m,) for m in [*ids, ids[0], None]], "member_id long"))
    assert sorted(r.member_id for r in got.collect()) == ids[:-1]
    plan = got._jdf.queryExecution().executedPlan()
    assert sum(int(n) for n in scans(plan, "numFiles")) == 3
    assert ("Exchange hashpartitioning" in plan.toString().split("Scan parquet")[0]) == (few == 0)
    assert export.read_careers(spark, path, spark.createDataFrame([], "member_id long")).count() == 0
