"""Metered model calls: prices, cost, error classes, model check."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prompts that a worker turns into strings at a time.
ROWS = 256

#: Neutral stand-ins for the eight providers of the dimension: prices per million tokens.
PROVIDERS = [
    ("p1", "model-a-pro", 1000000, "one", 3.13, 0.026, 6.26),
    ("p2", "model-b", 128000, "one", 10.0, None, 10.0),
    ("p3", "model-c", 128000, "one", 5.0, 1.0, 15.0),
    ("p4", "model-d", 200000, "two", 21.0, 2.1, 105.0),
    ("p5", "model-e", 64000, "one", 0.5, 0.1, 2.0),
    ("p6", "model-f", 32000, "one", 0.8, None, 2.0),
    ("p7", "model-g", 128000, "two", 18.0, 9.0, 72.0),
    ("p8", "model-h", 256000, "one", 4.0, 1.0, 16.0),
]


def providers(spark: SparkSession) -> DataFrame:
    from ..schemas import PROVIDER

    return spark.createDataFrame(PROVIDERS, PROVIDER)


def provider(spark: SparkSession, name: str) -> dict:
    """A provider's row; an unknown name is an error that lists the known ones."""
    rows = {r.provider: r.asDict() for r in providers(spark).collect()}  # 8 rows
    if name not in rows:
        raise ValueError(f"unknown provider {name}; known: {', '.join(sorted(rows))}")
    return rows[name]


def cost(usage: DataFrame, dimension: DataFrame) -> DataFrame:
    """usage (provider, input_tokens, cache_hit_tokens, cache_created_tokens, output_tokens) with cost.

    Both dialects by one rule: hits at the hit price, or the miss price where there is none; created tokens aren't charged
    (dialect "two"), other input is a miss.
    """
    priced = usage.join(F.broadcast(dimension), "provider")  # a dimension of 8 rows
    hit = F.coalesce("cache_hit_tokens", F.lit(0))
    created = F.when(F.col("sdk") == "two", F.coalesce("cache_created_tokens", F.lit(0))).otherwise(0)
    miss = F.col("input_tokens") - hit - created
    total = (hit * F.coalesce("input_hit", "input_miss") + miss * F.col("input_miss") + F.col("output_tokens") * F.col("output")) / F.lit(1000000.0)
    return priced.withColumn("cost", F.round(total, 6))


def error_class(message: Column) -> Column:
    """key / balance / rate / network / other, by the first that applies."""
    low = F.lower(message)

    def has(*words: str) -> Column:
        c = F.lit(False)
        for w in words:
            c = c | F.contains(low, F.lit(w))
        return c

    return (
        F.when(has("401", "unauthorized", "invalid api key"), "key")
        .when(has("402", "insufficient", "balance"), "balance")
        .when(has("429", "rate"), "rate")
        .when(has("timeout", "connection", "network"), "network")
        .otherwise("other")
    )


def model_ok(provider: Column, returned: Column, checked: str = "p1", part: str = "a-pro") -> Column:
    """Whether the returned model is the one asked for; only one provider is checked."""
    return (provider != checked) | F.contains(F.lower(returned), F.lit(part))


def require_model(df: DataFrame, checked: str = "p1", part: str = "a-pro") -> DataFrame:
    """df; a wrong model is an error at run time."""
    bad = F.raise_error(F.concat(F.lit("model downgraded: "), F.col("model_returned")))
    return df.withColumn("model_returned", F.when(model_ok(F.col("provider"), F.col("model_returned"), checked, part), F.col("model_returned")).otherwise(bad))


def stub_client(system: str, user: str) -> tuple[str, int, int, int]:
    """(content, input, output, cache-hit tokens), from the texts alone."""
    return user[:60], (len(system) + len(user)) // 4, min(len(user), 60) // 4, len(system) // 4 // 64 * 64


def call(prompts: DataFrame, client: Callable[[str, str], tuple[str, int, int, int]] = stub_client) -> DataFrame:
    """Replies (query_id, content, input_tokens, output_tokens, cache_hit_tokens) to prompts (query_id, system, user).

    The client is injected and called in the workers, a batch at a time; wrap it with retries, as a lost task calls again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # some rows at a time: texts are Python strings only for so many
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = [client(s or "", u or "") for s, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["query_id", "content", "input_tokens", "output_tokens", "cache_hit_tokens"])

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "system", "user").mapInArrow(run, f"query_id {kind}, content string, input_tokens long, output_tokens long, cache_hit_tokens long")
