"""A stored table that changes by whole versions: merge, insert and delete rewrite only the buckets they touch.

Rows are dealt over buckets by a hash of one column; a bucket's rows are a folder of files, sorted by that column. A
version is a small file that names each bucket's folder. A change writes new folders for the buckets that it touches, then
commits by giving its version file the next free number, which no two writers can get: the loser is refused, or
tries again from the newer version. A reader takes the newest version file and sees that version however long it reads,
until ``vacuum`` clears what only older versions name. A change that dies before its commit leaves folders that no version
names, and nothing else.

A change may carry a tag; a version lists the tags of all changes up to it, and a change whose tag is there already is
skipped. That makes a repeated step harmless (see operators.compaction).

Cases: null values of the bucket column share a bucket; keys with null match nothing, so a merge adds such rows; rows of a merge must have distinct
keys, else it is refused; columns that a merge lacks, and its nulls, keep the old values.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class WrittenMeanwhile(RuntimeError):
    """Another writer has taken the next version."""


class Version(NamedTuple):
    number: int
    schema: StructType
    bucket_by: str
    keys: list[str]
    buckets: int
    folders: dict[int, str]
    tags: list[str]


class Table:
    """A versioned table under a folder of a file system that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    @classmethod
    def create(cls, df: DataFrame, path: str, bucket_by: str, keys: list[str], buckets: int = 16) -> Table:
        """A new table with the rows of df as version 0."""
        table = cls(df.sparkSession, path)
        empty = Version(-1, df.schema, bucket_by, keys, buckets, {}, [])
        table._commit(empty, table._write(df, empty), None)
        return table

    def version(self, number: int | None = None) -> Version:
        """The newest version, or the one of that number."""
        if number is None:
            folder = self._hadoop.Path(f"{self.path}/versions")
            found = [int(f.getPath().getName()[:20]) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json")] if self._fs.exists(folder) else []
            if not found:
                raise FileNotFoundError(f"no table at {self.path}")
            number = max(found)
        stream = self._fs.open(self._version_path(number))
        try:
            said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, StructType.fromJson(said["schema"]), said["bucket_by"], said["keys"], said["buckets"], {int(k): v for k, v in said["folders"].items()}, said["tags"])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version."""
        at = self.version(number)
        return self._rows(at, list(at.folders))

    def lookup(self, values: list) -> DataFrame:
        """The rows with these values of the bucket column: only their buckets' files are read, and in these what may hold them."""
        at = self.version()
        wanted = self.spark.createDataFrame([(v,) for v in values], StructType([at.schema[at.bucket_by]]))
        near = {r.b for r in wanted.select(self._bucket(at).alias("b")).distinct().collect()}
        return self._rows(at, sorted(near & set(at.folders))).where(F.col(at.bucket_by).isin(values))

    def merge(self, new: DataFrame, tag: str | None = None, tries: int = 1) -> bool:
        """Put new's values that aren't null over the rows of equal keys; add the rows without one. Whether it was done (not skipped for its tag)."""

        def put(at: Version, old: DataFrame, mine: DataFrame) -> DataFrame:
            if not mine.where(" AND ".join(f"`{k}` IS NOT NULL" for k in at.keys)).groupBy(*at.keys).count().where("count > 1").isEmpty():
                raise ValueError(f"keys {at.keys} repeat in what is merged")
            o, n = old.alias("o"), mine.alias("n")
            on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in at.keys]
            value = {c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in mine.columns else F.col(f"o.{c}") for c in at.schema.names}
            return o.join(n, on, "full_outer").select(*[v.alias(c) for c, v in value.items()])

        return self._change(new, put, tag, tries)

    def insert_absent(self, new: DataFrame, tag: str | None = None, tries: int = 1) -> bool:
        """Add the rows whose keys the table lacks."""
        return self._change(new, lambda at, old, mine: old.unionByName(mine.join(old.select(*at.keys), at.keys, "left_anti"), allowMissingColumns=True), tag, tries)

    def delete(self, gone: DataFrame, tag: str | None = None, tries: int = 1) -> bool:
        """Remove the rows with the keys of gone, which has the bucket column too."""
        return self._change(gone, lambda at, old, mine: old.join(mine.select(*at.keys), at.keys, "left_anti"), tag, tries)

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders that none of the last versions names, and older version files; their number. Not while a writer works: its folders have no name yet."""
        newest = self.version().number
        named = {f.split("/")[1] for k in range(max(0, newest - keep + 1), newest + 1) for f in self.version(k).folders.values()}
        gone = [f.getPath() for f in self._fs.listStatus(self._hadoop.Path(f"{self.path}/data")) if f.getPath().getName() not in named]
        for k in range(newest - keep, -1, -1):
            if not self._fs.delete(self._version_path(k), False):
                break
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

    def _version_path(self, number: int):
        return self._hadoop.Path(f"{self.path}/versions/{number:020d}.json")

    @staticmethod
    def _bucket(at: Version):
        return F.pmod(F.xxhash64(F.col(at.bucket_by).cast(at.schema[at.bucket_by].dataType)), F.lit(at.buckets)).cast("int")

    def _rows(self, at: Version, buckets: list[int]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], at.schema)
        # looked up as they are: the folders' names are no columns
        return self.spark.read.schema(at.schema).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{at.folders[b]}" for b in buckets])

    def _write(self, rows: DataFrame, at: Version) -> dict[int, str]:
        """Folders of rows by bucket; buckets without rows have none."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("__bucket", self._bucket(at)).repartition(F.col("__bucket")).sortWithinPartitions("__bucket", at.bucket_by)
        dealt.write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop.Path(f"{self.path}/{folder}"))]
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("__bucket=")}

    def _commit(self, at: Version, folders: dict[int, str], tag: str | None) -> None:
        said = {"schema": at.schema.jsonValue(), "bucket_by": at.bucket_by, "keys": at.keys, "buckets": at.buckets, "folders": folders, "tags": [*at.tags, *([tag] if tag else [])]}
        target = self._version_path(at.number + 1)
        draft = self._hadoop.Path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(said).encode())
        stream.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, options)  # refused where the target exists
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise WrittenMeanwhile(f"version {at.number + 1} of {self.path}") from e
            raise

    def _change(self, mine: DataFrame, change: Callable[[Version, DataFrame, DataFrame], DataFrame], tag: str | None, tries: int) -> bool:
        while True:
            at = self.version()
            if tag is not None and tag in at.tags:
                return False
            kind = at.schema[at.bucket_by].dataType
            own = mine.withColumn(at.bucket_by, F.col(at.bucket_by).cast(kind))
            touched = sorted(r.b for r in own.select(self._bucket(at).alias("b")).distinct().collect())  # at most a number a bucket
            made = self._write(change(at, self._rows(at, [b for b in touched if b in at.folders]), own), at) if touched else {}
            folders = {b: f for b, f in at.folders.items() if b not in touched} | made
            try:
                self._commit(at, folders, tag)
                return True
            except WrittenMeanwhile:
                tries -= 1
                if not tries:
                    raise
