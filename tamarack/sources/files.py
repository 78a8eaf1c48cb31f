"""CSV and JSON files in, results out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.sources import schemas


#: A null value that no file holds: an unquoted empty field then differs from a quoted one.
_NO_TEXT = "\u0000"


#: Spellings of booleans, in any case, that a bulk load accepts (fixed values).
_TRUE = ("t", "tr", "tru", "true", "y", "ye", "yes", "on", "1")
_FALSE = ("f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0")


def _boolean(name: str) -> Column:
    text = F.lower(F.trim(F.col(name)))
    wrong = F.raise_error(F.concat(F.lit(f"Malformed boolean in {name}: "), F.col(name))).cast("boolean")
    return F.when(text.isNull(), F.lit(None)).when(text.isin(*_TRUE), F.lit(True)).when(text.isin(*_FALSE), F.lit(False)).otherwise(wrong)


def load_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    into: str,
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
    violations: dict[str, int] | None = None,
    checks: Mapping[str, str] | None = None,
) -> DataFrame:
    """Bulk load of CSV with a header into a typed Parquet table in the new folder ``into``, which is returned.

    Every field of every row is parsed and written, so one bad row fails the
    load whichever columns are read later. Fields are taken by position.
    ``columns`` names the fields of the file where it lacks some of the
    schema's; the missing ones are NULL. An unquoted empty field is NULL, a
    quoted one is empty text. Booleans are true, yes, on, 1, false, no, off, 0 and
    their beginnings, in any case. ``checks`` are conditions by name: while the
    rows are written, those for which one is false are counted into
    ``violations``; NULL passes, as in SQL, and every row is loaded.
    Fields with line breaks need ``multi_line``, which reads each file in one
    task.
    """
    given = schema if columns is None else T.StructType([schema[c] for c in columns])
    texts = T.StructType([T.StructField(f.name, T.StringType() if f.dataType == T.BooleanType() else f.dataType) for f in given])
    reader = spark.read.schema(texts).option("header", True).option("mode", "FAILFAST").option("enforceSchema", True)
    reader = reader.option("multiLine", multi_line).option("escape", '"').option("nullValue", _NO_TEXT)
    loaded = reader.csv(path).select(
        *[
            F.lit(None).cast(f.dataType).alias(f.name)
            if f.name not in given.names
            else (_boolean(f.name).alias(f.name) if f.dataType == T.BooleanType() else F.col(f.name))
            for f in schema
        ]
    )
    if checks and violations is not None:
        seen = Observation()
        loaded.observe(seen, *[F.count_if(~F.expr(condition)).alias(name) for name, condition in checks.items()]).write.parquet(into)
        violations |= seen.get
    else:
        loaded.write.parquet(into)
    return spark.read.schema(schema).parquet(into)


def load_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and types guessed from the data; costs a second read. Blank lines are skipped."""
    return spark.read.option("header", True).option("inferSchema", True).option("escape", '"').csv(path)


def load_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that each hold one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def normalise_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Boolean or numeric 0/1 flags as integers 0/1; NULL stays."""
    return df.withColumns({c: F.col(c).cast("int") for c in columns})


def load_account_profiles(spark: SparkSession, path: str, into: str) -> DataFrame:
    return normalise_flags(load_csv(spark, path, schemas.ACCOUNT_PROFILES, into), schemas.ACCOUNT_FLAGS)


def load_network_edges(spark: SparkSession, path: str, into: str) -> DataFrame:
    return load_csv(spark, path, schemas.NETWORK_EDGES, into)


def load_transactions(spark: SparkSession, path: str, into: str) -> DataFrame:
    return load_csv(spark, path, schemas.TRANSACTIONS, into)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """A result as parquet, or as CSV with a header; there NULL is an empty field and empty text is ``""``.

    Each task writes its own part file; ``partition_by`` lays large tables out
    by column so that later reads can skip folders.
    """
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", '""').option("nullValue", "")
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        writer.format(fmt).save(path)


def write_json_array(cells: DataFrame, path: str, order: Sequence[str]) -> None:
    """A small fixed grid, such as the 168 cells of the weekly heat map, as one JSON array.

    Meant for grids whose size does not depend on the data; anything larger
    belongs in ``write_result``.
    """
    packed = cells.select(F.struct(*order, *[c for c in cells.columns if c not in order]).alias("cell"))
    packed.agg(F.to_json(F.array_sort(F.collect_list("cell"))).alias("value")).coalesce(1).write.text(path)
