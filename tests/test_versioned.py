"""Stored tables by versions, and compaction that survives being killed between any two steps."""

from __future__ import annotations

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from studyloom.operators import compaction, history
from studyloom.sources import sinks
from studyloom.sources.versioned import Table, WrittenMeanwhile
from studyloom.streaming import stream

USERS = "user_id long, grade string, name string"


def users(spark, n=200):
    return spark.createDataFrame([(k, f"g{k % 3}", f"n{k}") for k in range(n)] + [(None, "none", "x")], USERS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path, at):
    out = {}
    for b, folder in at.folders.items():
        for name in os.listdir(f"{path}/{folder}"):
            out[b, name] = os.stat(f"{path}/{folder}/{name}").st_mtime_ns
    return out


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = Table.create(users(spark), path, "user_id", ["user_id"], buckets=8)
    before, old_files = table.version(), files(path, table.version())
    early = table.read()  # a reader from before the write
    new = spark.createDataFrame([(3, None, "renamed"), (7, "g9", None), (1000, "new", None)], USERS)
    assert table.merge(new)
    want = rows(sinks.upsert(users(spark), new, "user_id"))
    assert rows(table.read()) == want
    assert rows(early) == rows(table.read(0)) == rows(users(spark))
    after = table.version()
    same = {b for b in after.folders if after.folders[b] == before.folders.get(b)}
    assert len(same) >= 5 and {k: v for k, v in files(path, after).items() if k[0] in same} == {k: v for k, v in old_files.items() if k[0] in same}
    assert table.vacuum() == 0  # version 0's folder still holds what version 1 names
    table.merge(table.read().withColumn("grade", F.lit("all")).where("user_id IS NOT NULL"))
    assert rows(table.lookup([3, 1000])) == [(1000, "all", None), (3, "all", "renamed")]


def test_insert_delete_and_vacuum(spark, tmp_path):
    table = Table.create(users(spark, 50), str(tmp_path / "t"), "user_id", ["user_id"], buckets=4)
    table.insert_absent(spark.createDataFrame([(1, "other", "o"), (60, "g", "n60")], USERS))
    assert table.read().count() == 52 and rows(table.lookup([1])) == [(1, "g1", "n1")]
    table.delete(spark.createDataFrame([(k,) for k in range(100)], "user_id long"))
    assert rows(table.read()) == [(None, "none", "x")]
    assert table.vacuum() > 0 and rows(table.read()) == [(None, "none", "x")]
    table.merge(spark.createDataFrame([], USERS))
    assert table.read().count() == 1


def test_repeated_keys_are_refused(spark, tmp_path):
    table = Table.create(users(spark, 5), str(tmp_path / "t"), "user_id", ["user_id"])
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([(1, "a", "b"), (1, "c", "d")], USERS))
    assert table.version().number == 0
    with pytest.raises(FileNotFoundError):
        Table(spark, str(tmp_path / "none")).read()


def test_two_writers_and_tags(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table, other = Table.create(users(spark, 20), path, "user_id", ["user_id"]), Table(spark, path)
    new = spark.createDataFrame([(2, "mine", None)], USERS)
    write = Table._write

    def late(self, df, at):  # the other one commits while this one writes
        made = write(self, df, at)
        if self is table and at.number == 0:
            other.merge(spark.createDataFrame([(4, "theirs", None)], USERS))
        return made

    monkeypatch.setattr(Table, "_write", late)
    with pytest.raises(WrittenMeanwhile):
        table.merge(new)
    monkeypatch.setattr(Table, "_write", write)
    assert table.merge(new, tag="a", tries=2) and not table.merge(spark.createDataFrame([(2, "again", None)], USERS), tag="a")
    got = {r.user_id: r.grade for r in table.read().collect()}
    assert got[2] == "mine" and got[4] == "theirs" and table.version().number == 2


HISTORY = "user_id long, id long, query string, cost double, created_at timestamp_ntz"
SUMMARIES = "user_id long, period string, summary string, compressed_count long, compression_ratio string"
AS_OF = "2024-06-01"


def asked(first=0, n=240):
    start = dt.datetime(2023, 1, 1)
    return [(k % 5, k, f"q{k}", 1.0, start + dt.timedelta(days=2 * k)) for k in range(first, first + n)]


def stored(spark, folder, data):
    h = Table.create(spark.createDataFrame(data, HISTORY), f"{folder}/h", "user_id", ["id"], buckets=4)
    s = Table.create(spark.createDataFrame([], SUMMARIES), f"{folder}/s", "user_id", ["user_id", "period"], buckets=4)
    return h, s, f"{folder}/ledger"


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["prepared", "inserted", "deleted"])
def test_killed_and_repeated(spark, tmp_path, step):
    calm, hurt = stored(spark, f"{tmp_path}/calm", asked()), stored(spark, f"{tmp_path}/hurt", asked())
    compaction.run(spark, *calm, "b1", AS_OF)

    def kill(at):
        if at == step:
            raise Killed

    with pytest.raises(Killed):
        compaction.run(spark, *hurt, "b1", AS_OF, between=kill)
    assert compaction.open_batches(spark, hurt[2]) == ["b1"]
    # the next run, whatever it is called, ends the open one; a model's other answers don't matter, as the first ones were kept
    compaction.run(spark, *hurt, "b1", AS_OF, summary=F.lit("another answer"))
    assert rows(hurt[0].read()) == rows(calm[0].read()) and rows(hurt[1].read()) == rows(calm[1].read())
    versions = hurt[0].version().number, hurt[1].version().number
    compaction.run(spark, *hurt, "b1", AS_OF)
    assert (hurt[0].version().number, hurt[1].version().number) == versions == (1, 1)
    made, left, _ = history.compact(spark.createDataFrame(asked(), HISTORY), spark.createDataFrame([], SUMMARIES), AS_OF)
    assert rows(hurt[1].read().select(*made.columns)) == rows(made) and rows(hurt[0].read()) == rows(left.select(*hurt[0].read().columns))


def test_killed_while_writing_down(spark, tmp_path, monkeypatch):
    h, s, ledger = stored(spark, str(tmp_path), asked())
    monkeypatch.setattr(history, "summaries_of", lambda *a: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        compaction.run(spark, h, s, ledger, "b1", AS_OF)
    monkeypatch.undo()
    assert compaction.open_batches(spark, ledger) == [] and h.read().count() == 240
    compaction.run(spark, h, s, ledger, "b1", AS_OF)
    assert s.read().count() > 0


def test_late_rows_stay(spark, tmp_path):
    h, s, ledger = stored(spark, str(tmp_path), asked())
    compaction.run(spark, h, s, ledger, "b1", AS_OF)
    n = s.read().count()
    late = [(0, 10_000 + k, "late", 1.0, dt.datetime(2023, 1, 5)) for k in range(40)]
    h.insert_absent(spark.createDataFrame(late, HISTORY))
    compaction.run(spark, h, s, ledger, "b2", AS_OF)
    assert s.read().count() == n and h.read().where("query = 'late'").count() == 40


def test_stream_of_batches_repeated(spark, tmp_path):
    """Micro-batches of history: killed in the second batch and started again, the tables are those of an undisturbed run."""
    data = asked()
    for k in range(3):
        spark.createDataFrame(data[k * 80 : (k + 1) * 80], HISTORY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    read = spark.readStream.schema(HISTORY).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tables = {}
    for name in ("calm", "hurt"):
        h, s, ledger = tables[name] = stored(spark, f"{tmp_path}/{name}", [])
        work, seen = compaction.by_batches(h, s, ledger, AS_OF), []

        def once(df, n, work=work, seen=seen, name=name):
            work(df, n)
            seen.append(n)
            if name == "hurt" and n == 1 and seen.count(1) == 1:
                raise Killed  # after the work, before the stream's own mark

        for _ in range(2):
            try:
                stream.in_batches(read, once, f"{tmp_path}/cp-{name}").awaitTermination(120)
            except Exception as e:
                assert name == "hurt" and "Killed" in str(e)
    assert rows(tables["hurt"][0].read()) == rows(tables["calm"][0].read()) and rows(tables["hurt"][1].read()) == rows(tables["calm"][1].read())
