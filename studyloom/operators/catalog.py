"""Catalogue checks: counts, foreign keys, required files, table listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """reference, key_value of child rows without a parent."""
    keys = child.select(F.col(key).alias("key_value")).where("key_value IS NOT NULL")
    return keys.join(parent.select(F.col(parent_key).alias("key_value")), "key_value", "left_anti").select(F.lit(name).alias("reference"), "key_value")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """rule, broken: primary keys, unique keys and references of the schema registry that the tables break, for tables given."""
    keys = {(name, (key,)) for name, (_, key) in schemas.TABLES.items()} | {(name, tuple(k)) for name, k in schemas.UNIQUE.items()}
    out = None
    for name, key in sorted(keys):
        if name in tables:
            one = duplicates(tables[name], list(key)).agg(F.count("*").alias("broken")).select(F.lit(f"{name}({', '.join(key)})").alias("rule"), "broken")
            out = one if out is None else out.unionAll(one)
    for child, key, parent, parent_key in schemas.FOREIGN_KEYS:
        if child in tables and parent in tables:
            rule = f"{child}.{key} -> {parent}.{parent_key}"
            one = violations(tables[child], key, tables[parent], parent_key, rule).agg(F.count("*").alias("broken")).select(F.lit(rule).alias("rule"), "broken")
            out = one if out is None else out.unionAll(one)
    return out.where("broken > 0")


def missing(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of expected (name) that no present path contains. expected is a short list of required files, so it is what is broadcast, not the listing."""
    found = present.join(F.broadcast(expected), F.contains(present["path"], expected["name"])).select(expected["name"]).distinct()
    return expected.join(found, "name", "left_anti")


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean")


def new_anonymous_id() -> Column:
    """anon_ and 16 random hexadecimal digits."""
    return F.concat(F.lit("anon_"), F.substring(F.sha2(F.expr("uuid()"), 256), 1, 16))


def anonymous_id(c: Column) -> Column:
    return c.startswith("anon_") & (F.length(c) == 21)


def command(text: Column) -> Column:
    """exit / profile / cost for reserved words, blank for nothing, else query."""
    t = F.trim(text)
    return F.when(t == "", "blank").when(t.isin("exit", "quit", "q"), "exit").when(t == "profile", "profile").when(t == "cost", "cost").otherwise("query")


def ready(key: Column, grade: Column) -> Column:
    """Whether a session may ask: a key that isn't blank, and a grade. Null counts as empty."""
    return (F.trim(F.coalesce(key, F.lit(""))) != "") & (F.coalesce(grade, F.lit("")) != "")
