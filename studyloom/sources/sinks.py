"""Writes. Plain files know no MERGE or DELETE: changes are whole new versions, written beside what is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_history(df: DataFrame, path: str, rows_of_group: int = 100_000) -> None:
    """History by month, sorted by user and time in each file: in place of secondary indexes, scans prune months and skip users. A month is dealt over 16 tasks by user.

    Row groups are small and have Bloom filters of user and id, so a lookup skips those that can't hold what it looks for.
    """
    dealt = df.withColumn("month", F.date_format("created_at", "yyyy-MM")).repartition("month", F.pmod(F.xxhash64("user_id"), F.lit(16))).sortWithinPartitions("user_id", "created_at")
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("user_id", "id") if c in df.columns}
    dealt.write.mode("overwrite").options(**blooms, **{"parquet.block.row.count.limit": str(rows_of_group)}).partitionBy("month").parquet(path)


#: So many values are pushed into the scan as a list; more of them are joined.
LISTED = 1000


def lookup_history(spark: SparkSession, path: str, wanted: list, key: str = "user_id", months: list[str] | None = None) -> DataFrame:
    """The stored rows of some users (or ids), of some months only where they are known: row groups that hold none of them aren't read."""
    rows = spark.read.parquet(path)
    if months is not None:
        rows = rows.where(F.col("month").isin(months))
    if len(wanted) <= LISTED:
        return rows.where(F.col(key).isin(list(wanted)))
    kind = rows.schema[key].dataType.simpleString()
    listed = spark.createDataFrame([(x,) for x in set(wanted)], f"`{key}` {kind}")
    ends = F.col(key).between(min(wanted), max(wanted))
    return rows.where(ends).join(listed, key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's columns put over it where they aren't null; rows of new without an old one are added."""
    other = [c for c in new.columns if c != key]
    renamed = new.select(key, *[F.col(c).alias(f"__new_{c}") for c in other])
    joined = old.join(renamed, key, "full_outer")
    kept = [F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in other else F.col(c) for c in old.columns]
    added = [F.col(f"__new_{c}").alias(c) for c in other if c not in old.columns]
    return joined.select(*kept, *added)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def delete_by_id(df: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def swap(df: DataFrame, path: str) -> None:
    """Replace the table at path by df, which may read it: written beside it, then renamed.

    The old table stays as path.old until the new one is in place. A failed rename puts it back and raises; after a crash
    between the renames ``recover`` does. Between the renames a reader finds no table; sources.versioned has no such moment.
    """
    spark = df.sparkSession
    recover(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.next")
    fs, now, then, old = _places(spark, path)
    fs.delete(old, True)
    if fs.exists(now) and not fs.rename(now, old):
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(then, now):
        recover(spark, path)
        raise OSError(f"{path}.next can't take the place of {path}")
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> None:
    """Put back the old table where a swap was cut short before the new one was in place."""
    fs, now, _, old = _places(spark, path)
    if not fs.exists(now) and fs.exists(old) and not fs.rename(old, now):
        raise OSError(f"{path}.old can't be put back")


def _places(spark: SparkSession, path: str) -> tuple:
    hadoop = spark._jvm.org.apache.hadoop.fs
    now, then, old = hadoop.Path(path), hadoop.Path(f"{path}.next"), hadoop.Path(f"{path}.old")
    return now.getFileSystem(spark._jsc.hadoopConfiguration()), now, then, old


def export_user(spark: SparkSession, tables: dict[str, DataFrame], user_id: str) -> DataFrame:
    """One JSON document with a user's rows of each table and their counts."""
    parts = None
    for name, df in sorted(tables.items()):
        own = df.where(F.col("user_id") == user_id)
        one = own.agg(F.sort_array(F.collect_list(F.to_json(F.struct(*own.columns)))).alias("rows"), F.count("*").alias("n")).select(F.lit(name).alias("name"), "rows", "n")
        parts = one if parts is None else parts.unionByName(one)
    made = F.map_from_entries(F.collect_list(F.struct("name", F.struct("n", "rows"))))
    return parts.agg(F.sum("n").alias("total"), F.to_json(made).alias("document")).select(F.lit(user_id).alias("user_id"), "total", "document")


def replace_all(df: DataFrame, column: str, pairs: dict[str, str]) -> DataFrame:
    """Literal replacements, in order."""
    c = F.col(column)
    for old, new in pairs.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return df.withColumn(column, c)
