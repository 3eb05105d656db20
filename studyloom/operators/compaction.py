"""Quarter compaction of stored history, exactly once.

A run is a batch with a name. What it will do is written down first: the summaries and the rows that they stand for, in a
ledger folder that appears under the batch's name in one rename. Then the summaries are added, then the rows are removed, each
in one commit tagged with the batch (sources.versioned), then the batch is marked done. A run that dies anywhere is
finished by ``recover``, which every run calls first: it takes the summaries from the ledger, so a model isn't asked twice,
and the tags tell which commits were made. Rows that come for a quarter that has its summary stay (late data isn't summarised again).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists
from ..sources.versioned import Table
from . import history as h


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def prepare(spark: SparkSession, rows: Table, summaries: Table, ledger: str, batch: str, as_of: str, summary: Column | None = None, only_complete_quarters: bool = False) -> None:
    """Write down a batch: ledger/batch/summaries, ledger/batch/rows (user_id, period, id)."""
    draft = f"{ledger}/.{uuid.uuid4().hex}"
    due = h.compactable(rows.read(), summaries.read().select("user_id", "period"), as_of, only_complete_quarters)
    due.select("user_id", "period", "id").write.parquet(f"{draft}/rows")
    # from the rows written down: both stand for the same ones
    listed = spark.read.parquet(f"{draft}/rows").select("id", F.col("period").alias("__period"))
    own = rows.read().join(listed, "id").withColumnRenamed("__period", "period")
    h.summaries_of(h.quarter_texts(own), summary).write.parquet(f"{draft}/summaries")
    fs = _path(spark, ledger).getFileSystem(spark._jsc.hadoopConfiguration())
    if exists(spark, f"{ledger}/{batch}") or not fs.rename(_path(spark, draft), _path(spark, f"{ledger}/{batch}")):
        raise FileExistsError(f"batch {batch} is written down already")


def finish(spark: SparkSession, rows: Table, summaries: Table, ledger: str, batch: str, between: Callable[[str], None] = lambda step: None) -> None:
    """Carry out a batch that is written down; what was done of it already is skipped."""
    own = f"{ledger}/{batch}"
    between("prepared")
    summaries.insert_absent(spark.read.parquet(f"{own}/summaries"), batch, tries=3)
    between("inserted")
    rows.delete(spark.read.parquet(f"{own}/rows").select("user_id", "id"), batch, tries=3)
    between("deleted")
    spark.range(1).write.mode("overwrite").parquet(f"{own}/done")


def open_batches(spark: SparkSession, ledger: str) -> list[str]:
    """Batches that are written down but not done, by name."""
    if not exists(spark, ledger):
        return []
    fs = _path(spark, ledger).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(_path(spark, ledger))]
    return sorted(n for n in names if not n.startswith(".") and not exists(spark, f"{ledger}/{n}/done/_SUCCESS"))


def recover(spark: SparkSession, rows: Table, summaries: Table, ledger: str) -> list[str]:
    """Finish what earlier runs left open."""
    found = open_batches(spark, ledger)
    for batch in found:
        finish(spark, rows, summaries, ledger, batch)
    return found


def run(spark: SparkSession, rows: Table, summaries: Table, ledger: str, batch: str, as_of: str, summary: Column | None = None, between: Callable[[str], None] = lambda step: None) -> None:
    """Compaction as batch, once: a second run of the same name does nothing. between is called after each step."""
    recover(spark, rows, summaries, ledger)
    if exists(spark, f"{ledger}/{batch}"):
        return
    prepare(spark, rows, summaries, ledger, batch, as_of, summary)
    finish(spark, rows, summaries, ledger, batch, between)


def by_batches(rows: Table, summaries: Table, ledger: str, as_of: str) -> Callable[[DataFrame, int], None]:
    """Work for stream.in_batches: each micro-batch of new history is added and then compacted, once however often the batch is repeated."""

    def work(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        rows.insert_absent(new, f"new-{number}", tries=3)
        run(spark, rows, summaries, ledger, f"batch-{number}", as_of)

    return work
