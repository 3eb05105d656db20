"""Readers of the files that the application keeps."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a table's files: another tuple means another state of the table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a missing file has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def keyed_jsonl(spark: SparkSession, path: str, schema: StructType, key: str, line: str = "line_no") -> DataFrame:
    """As jsonl, one row for each key: that of the highest line number, which the file itself carries."""
    rows = jsonl(spark, path, StructType([*schema.fields]).add(line, "long"))
    return last_by_key(rows, key, line).drop(line)


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    nr = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("__nr", nr).where("__nr = 1").drop("__nr")


def vectors(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """A vector index: pos, embedding. Missing files and vectors of another dimension are errors."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    if dimension is None:
        return df
    fits = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("vector dimension "), F.size("embedding").cast("string"))))
    return df.withColumn("embedding", fits)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def file_list(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length of all files below; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length")


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def load_config(path: str) -> dict:
    """Options of the application; JSON, or YAML where that parser is installed. A missing file is an error."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        import yaml  # optional

        return yaml.safe_load(text) or {}


def resolve_index_dir(*places: str) -> str:
    """The first place that exists, symbolic links followed. Nothing is downloaded."""
    for p in places:
        if p and os.path.isdir(os.path.realpath(p)):
            return os.path.realpath(p)
    raise FileNotFoundError(", ".join(p for p in places if p))


def query_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Queries (query_id, text) as JSON files arrive in a folder."""
    return spark.readStream.schema("query_id bigint, text string").json(folder)


def jdbc_table(spark: SparkSession, url: str, table: str, partition_by: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database server; filters and columns are pushed down.

    partition_by: a number or time column whose range is read in so many parts at once; its bounds are asked of the server. Rows where it is null
    are in the first part. Without it, or for an empty table, one task reads all.
    """
    read = spark.read.format("jdbc").options(url=url, **options)
    if partition_by:
        ends = read.option("dbtable", f"(SELECT MIN({partition_by}) AS least, MAX({partition_by}) AS most FROM {table}) ends").load().first()
        if ends[0] is not None:
            read = read.options(partitionColumn=partition_by, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=str(parts))
    return read.option("dbtable", table).load()


def jdbc_catalog(spark: SparkSession, url: str) -> DataFrame:
    """name, kind (table, unique or index), columns of a server's own tables and their indexes."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    rows = []
    try:
        said = connection.getMetaData()
        found = said.getTables(None, None, "%", None)
        while found.next():
            if found.getString("TABLE_TYPE") != "TABLE":
                continue
            schema, name = found.getString("TABLE_SCHEM"), found.getString("TABLE_NAME")
            columns = said.getColumns(None, schema, name, "%")
            listed = []
            while columns.next():
                listed.append((columns.getInt("ORDINAL_POSITION"), columns.getString("COLUMN_NAME")))
            rows.append((name, "table", [c for _, c in sorted(listed)]))
            keys: dict[tuple[str, bool], list] = {}
            index = said.getIndexInfo(None, schema, name, False, True)
            while index.next():
                if index.getString("INDEX_NAME"):
                    keys.setdefault((index.getString("INDEX_NAME"), bool(index.getBoolean("NON_UNIQUE"))), []).append((index.getInt("ORDINAL_POSITION"), index.getString("COLUMN_NAME")))
            rows += [(name, "index" if several else "unique", [c for _, c in sorted(own)]) for (_, several), own in sorted(keys.items())]
    finally:
        connection.close()
    return spark.createDataFrame(rows, "name string, kind string, columns array<string>")


def environment(names: Sequence[str], file: str | None = None) -> dict[str, str]:
    """Settings of the driver's environment, and where it lacks one of NAME=value lines of a file that may be missing. Names without a value have none."""
    held: dict[str, str] = {}
    if file and os.path.isfile(file):
        with open(file, encoding="utf-8") as f:
            for line in f:
                name, sign, value = line.strip().partition("=")
                if sign and not name.startswith("#"):
                    held[name.strip()] = value.strip().strip("'\"")
    return {n: os.environ.get(n, held.get(n)) for n in names if n in os.environ or n in held}
