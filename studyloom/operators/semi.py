"""Semi-structured columns: JSON texts as variants, with fields and types found from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str) -> DataFrame:
    """df with v, the text of the column as a variant, and malformed: whether there is a text that isn't JSON."""
    v = F.try_parse_json(F.col(column))
    return df.withColumn("v", v).withColumn("malformed", F.col(column).isNotNull() & v.isNull())


def fields(df: DataFrame, column: str) -> DataFrame:
    """field, type, n: the top-level fields of a column's objects, the type that fits all their values, and in how many rows each is. Other values have no fields."""
    rows = parsed(df.select(column), column).where("v IS NOT NULL")
    rows.createOrReplaceTempView(name := f"semi_{abs(hash((id(rows), column)))}")
    try:
        each = df.sparkSession.sql(f"SELECT e.key AS field, e.value AS value FROM {name}, LATERAL variant_explode(v) AS e(pos, key, value) WHERE e.key IS NOT NULL")
        return each.groupBy("field").agg(F.schema_of_variant_agg("value").alias("type"), F.count("*").alias("n"))
    finally:
        df.sparkSession.catalog.dropTempView(name)


def typed(df: DataFrame, column: str, found: list[tuple[str, str]] | None = None) -> DataFrame:
    """df with malformed and a column for each field, called as the field, of the found type: null where a row lacks it or holds another type.

    found: (field, type), by default those of ``fields``, whose number is that of the columns to be made. Fields of mixed types stay variants.
    """
    own = found if found is not None else [(r.field, r.type) for r in fields(df, column).orderBy("field").collect()]
    rows = parsed(df, column)
    made = []
    for field, kind in own:
        quote = "'" if "'" not in field else '"'
        if quote in field:
            raise ValueError(f"no path leads to a field with both kinds of quotes: {field}")
        path = f"$[{quote}{field}{quote}]"
        made.append(F.try_variant_get("v", path, "variant" if kind in ("VARIANT", "VOID") else kind.replace("OBJECT<", "STRUCT<")).alias(field))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], "malformed", *made)
