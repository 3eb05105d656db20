"""A database server as a source, data skipping in stored history, settings, variants, scopes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from studyloom.operators import history, semi
from studyloom.sources import adapters as ad
from studyloom.sources import files, sinks


@pytest.fixture(scope="module")
def server(spark, sf001):
    """The embedded database that ships with Spark, with the orders as history."""
    url = "jdbc:derby:memory:history;create=true"
    ad.history_quarters(spark, sf001).withColumn("created_at", F.col("created_at").cast("timestamp")).write.format("jdbc").options(url=url, dbtable="asked").save()
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    connection.createStatement().execute('CREATE INDEX by_user ON asked ("user_id", "id")')
    connection.close()
    return url


def test_month_cost_of_a_server(spark, sf001, server):
    rows = files.jdbc_table(spark, server, "asked", '"id"', 4)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == ad.history_quarters(spark, sf001).count()
    cost = history.month_cost(rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), "1997-12")
    assert sorted(map(tuple, cost.collect())) == sorted(map(tuple, history.month_cost(ad.history_quarters(spark, sf001), "1997-12").collect()))
    one = rows.where("user_id = 7 AND id > 100").select("cost")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in plan and "GreaterThan(id,100)" in plan and "created_at" not in plan.split("ReadSchema")[-1]
    empty = files.jdbc_table(spark, server, '(SELECT * FROM asked WHERE "id" < 0) nothing', '"id"', 4)
    assert empty.isEmpty()


def test_catalog_of_a_server(spark, server):
    got = {(r.name, r.kind): r.columns for r in files.jdbc_catalog(spark, server).collect()}
    assert got["ASKED", "index"] == ["user_id", "id"] and "created_at" in got["ASKED", "table"]


def rows_read(df):
    """Rows that the scan gave to the filter."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_lookups_skip_row_groups(spark, sf001, tmp_path):
    start = dt.datetime(2024, 1, 1)
    data = spark.range(40_000).select((F.col("id") * 7919 % 5000).alias("user_id"), "id", F.lit("q").alias("query"), (F.lit(start).cast("timestamp_ntz") + F.expr("make_interval(0, 0, 0, cast(id % 60 as int))")).alias("created_at"))
    sinks.write_history(data, f"{tmp_path}/h", 200)
    held = spark.read.parquet(f"{tmp_path}/h")
    wanted = list(range(3, 5000, 1000))
    got = sinks.lookup_history(spark, f"{tmp_path}/h", wanted)
    assert sorted(map(tuple, got.select("id").collect())) == sorted(map(tuple, held.where(F.col("user_id").isin(wanted)).select("id").collect()))
    assert 0 < rows_read(got) < 0.3 * held.count()
    by_id = sinks.lookup_history(spark, f"{tmp_path}/h", [17, 10**9], "id")  # files aren't sorted by id: the Bloom filters tell
    assert by_id.count() == 1 and rows_read(by_id) < 0.2 * held.count()
    month = sinks.lookup_history(spark, f"{tmp_path}/h", wanted, months=["2024-02"])
    assert month.count() == held.where(F.col("user_id").isin(wanted) & (F.col("month") == "2024-02")).count()
    many = list(range(0, 5000, 2))
    assert sinks.lookup_history(spark, f"{tmp_path}/h", many).count() == held.where("user_id % 2 = 0").count()


def test_environment(tmp_path, monkeypatch):
    (tmp_path / "env").write_text("# notes\nA=1\nB = 'two words'\nC\n\n")
    monkeypatch.setenv("B", "from outside")
    monkeypatch.delenv("A", raising=False)
    assert files.environment(["A", "B", "C", "D"], str(tmp_path / "env")) == {"A": "1", "B": "from outside"}
    assert files.environment(["A"], str(tmp_path / "none")) == {}


def test_variants(spark):
    texts = ['{"a": 1, "b": "x", "it\'s": 2.5}', '{"a": "one"}', '{"a": 3', None, "[1, 2]", "7", "", '{"b": null, "c": {"d": [1]}}']
    df = spark.createDataFrame(list(enumerate(texts)), "nr int, props string")
    found = {r.field: (r.type, r.n) for r in semi.fields(df, "props").collect()}
    assert found["a"] == ("VARIANT", 2) and found["b"] == ("STRING", 2) and found["c"][0].startswith("OBJECT") and set(found) == {"a", "b", "c", "it's"}
    got = {r.nr: r for r in semi.typed(df, "props", [("a", "bigint"), ("b", "string"), ("it's", "double")]).collect()}
    assert [k for k, r in got.items() if r.malformed] == [2, 6]
    assert (got[0].a, got[0].b, got[0]["it's"]) == (1, "x", 2.5) and got[1].a is None and got[4].a is None
    assert semi.typed(df, "props").columns == ["nr", "props", "malformed", "a", "b", "c", "it's"]


def test_own_rows_only(spark, sf001):
    users = spark.createDataFrame([(1,), (2,), (None,)], "user_id long")
    tables = {"query_history": ad.history_quarters(spark, sf001), "users": ad.users(spark, sf001), "user_profile": ad.profiles(spark, sf001), "nodes": ad.graph_nodes(spark, sf001)}
    own = history.Own(users, tables)
    assert {r.user_id for t in ("query_history", "users", "user_profile") for r in own[t].select("user_id").collect()} <= {1, 2}
    assert {r.user_id for r in own.recent_text("1998-01-01").collect()} == {1, 2} == {r.user_id for r in own.profiles().collect()}
    with pytest.raises(KeyError):
        own["nodes"]
    with pytest.raises(ValueError):
        history.visible(tables["users"], None)
