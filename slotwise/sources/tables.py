"""Reading source tables, binding their columns to canonical fields, and writing results."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions.numbers import combine, to_number
from slotwise.functions.slots import slot_of, slot_start
from slotwise.operators.grid import align, collapse, lengthen, resample

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


@dataclass(frozen=True)
class FieldSpec:
    """How one canonical field is found and folded."""

    name: str
    sources: Sequence[str] = ()
    patterns: Sequence[str] = ()
    combine: str | None = None
    aggregate: str = "mean"
    required: bool = False


@dataclass(frozen=True)
class TableSpec:
    name: str
    time_column: str
    fields: Sequence[FieldSpec] = field(default_factory=tuple)
    time_format: str = TIME_FORMAT
    required: bool = True
    time_series: bool = True
    series: str | None = None


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV or Parquet by suffix; CSV columns stay text unless a schema is given."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if kind == "csv":
        reader = spark.read.option("header", True).option("encoding", "UTF-8")
        table = (reader.schema(schema) if schema else reader).csv(path)
        first = table.columns[0]
        return table.withColumnRenamed(first, first.lstrip("\ufeff"))
    raise ValueError(f"unsupported table suffix: {path}")


def resolve_sources(columns: Sequence[str], spec: FieldSpec) -> list[str]:
    """Named sources in their order, then full regex matches in column order, each once."""
    found = [name for name in spec.sources if name in columns]
    for pattern in spec.patterns:
        found += [name for name in columns if re.fullmatch(pattern, name)]
    return list(dict.fromkeys(found))


def bind_fields(df: DataFrame, fields: Sequence[FieldSpec]) -> dict[str, Column]:
    """Canonical name -> numeric column expression; several sources add up unless told otherwise."""
    bound: dict[str, Column] = {}
    for spec in fields:
        names = resolve_sources(df.columns, spec)
        if not names:
            if spec.required:
                raise ValueError(f"no source column for required field {spec.name}")
            continue
        if spec.name in bound:
            raise ValueError(f"field defined twice: {spec.name}")
        rule = spec.combine or ("sum" if len(names) > 1 else "first")
        bound[spec.name] = combine([to_number(F.col(f"`{n}`")) for n in names], rule)
    return bound


def parse_time(df: DataFrame, column: str, fmt: str = TIME_FORMAT) -> Column:
    """Zone-free timestamp; text that does not parse becomes null."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.try_to_timestamp(F.col(column), F.lit(fmt)).cast("timestamp_ntz")
    return F.col(column).cast("timestamp_ntz")


def bind_table(df: DataFrame, spec: TableSpec, ordinal: str | None = None) -> DataFrame:
    """(series_id, ts, fields..., _ord): mapped, numeric, rows without a readable time dropped."""
    bound = bind_fields(df, spec.fields)
    series = F.col(spec.series).cast("string") if spec.series else F.lit("series_0")
    order = F.col(ordinal) if ordinal else F.monotonically_increasing_id()
    return df.select(
        series.alias("series_id"), parse_time(df, spec.time_column, spec.time_format).alias("ts"),
        *[c.alias(n) for n, c in bound.items()], order.alias("_ord"),
    ).where(F.col("ts").isNotNull())


def bin_table(
    df: DataFrame, spec: TableSpec, step_seconds: int, label: str = "right", closed: str = "right",
    ordinal: str | None = None,
) -> DataFrame:
    """One table as long bins (series_id, field, pos, value): same-time rows first, then slots."""
    rows = bind_table(df, spec, ordinal)
    names = [c for c in rows.columns if c not in ("series_id", "ts", "_ord")]
    methods = {f.name: f.aggregate for f in spec.fields if f.name in names}
    moments = collapse(rows, ["series_id", "ts"], methods, "_ord")
    bins = resample(moments, ["series_id"], "ts", methods, step_seconds, label, closed, ordinal="ts")
    return lengthen(bins, names)


def load_aligned(
    spark: SparkSession, sources: Sequence[tuple[TableSpec, DataFrame | str]], step_seconds: int,
    label: str = "right", closed: str = "right",
) -> DataFrame:
    """All time-series tables on one grid; an unreadable optional table is left out."""
    binned, summed = {}, []
    for spec, origin in sources:
        if not spec.time_series:
            continue
        try:
            df = read_table(spark, origin) if isinstance(origin, str) else origin
        except Exception:
            if spec.required:
                raise
            continue
        binned[spec.name] = bin_table(df, spec, step_seconds, label, closed)
        summed += [f.name for f in spec.fields if f.aggregate == "sum"]
    return align(binned, summed)


def table_quality(df: DataFrame, spec: TableSpec, step_seconds: int) -> DataFrame:
    """Rows read, rows with an unreadable time, repeated times and filled slots of one table."""
    rows = df.select(
        (F.col(spec.series).cast("string") if spec.series else F.lit("series_0")).alias("series_id"),
        parse_time(df, spec.time_column, spec.time_format).alias("ts"))
    moments = rows.groupBy("series_id", "ts").agg(F.count(F.lit(1)).alias("n"))
    slots = moments.withColumn("pos", slot_of("ts", step_seconds)).groupBy("series_id", "pos").agg(
        F.sum("n").alias("rows"), F.count("ts").alias("moments"))
    filled = F.col("pos").isNotNull()
    return slots.groupBy("series_id").agg(
        F.sum("rows").alias("input_rows"),
        F.coalesce(F.sum(F.when(~filled, F.col("rows"))), F.lit(0)).alias("invalid_rows"),
        F.sum(F.when(filled, F.col("rows") - F.col("moments")).otherwise(0)).alias("duplicate_rows"),
        F.count("pos").alias("filled_slots"),
        (F.max("pos") - F.min("pos") + 1).alias("output_rows"),
    ).select(F.lit(spec.name).alias("table"), "*")


def load_original_columns(
    tables: dict[str, DataFrame], time_column: str = "datetime", fmt: str = TIME_FORMAT,
) -> DataFrame:
    """Scoring tables under their original names, joined on time; bad or repeated times fail."""
    from slotwise.operators.grid import outer_align
    from slotwise.plans.contracts import require_zero

    parts = []
    for name, df in tables.items():
        stamped = df.withColumn("ts", parse_time(df, time_column, fmt)).drop(time_column)
        bad = stamped.where(F.col("ts").isNull())
        twice = stamped.groupBy("ts").count().where("count > 1")
        require_zero(bad, f"{name}: unreadable time")
        require_zero(twice, f"{name}: repeated time")
        parts.append(stamped)
    return outer_align(parts, ["ts"])


def write_frame(df: DataFrame, path: str, step_seconds: int, kind: str = "parquet", digits: int = 6) -> None:
    """Formatted ``datetime`` first, doubles rounded; Parquet by default, CSV on request."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    rest = [
        F.round(c, digits).alias(c) if c in numeric else F.col(c)
        for c in df.columns if c not in ("pos", "ts", "datetime")
    ]
    ts = slot_start("pos", step_seconds) if "pos" in df.columns else F.col("ts")
    stamped = df.select(F.date_format(ts, TIME_FORMAT).alias("datetime"), *rest)
    writer = stamped.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def read_frame(spark: SparkSession, path: str, schema: T.StructType | None = None, kind: str = "parquet") -> DataFrame:
    raw = (
        spark.read.option("header", True).schema(schema).csv(path) if kind == "csv" else spark.read.parquet(path)
    )
    return raw.select(parse_time(raw, "datetime").alias("ts"), *[c for c in raw.columns if c != "datetime"])


def materialise(df: DataFrame, path: str, partition_by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Write a shared stage once as Parquet and hand back the reader."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_reports(reports: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    for name, df in reports.items():
        writer = df.write.mode("overwrite")
        target = f"{folder.rstrip('/')}/{name}"
        writer.option("header", True).csv(target) if kind == "csv" else writer.parquet(target)


# fixed values: where a row may come from
SOURCE_TAGS = ("training", "scoring", "synthetic")


def tag_source(df: DataFrame, tag: str) -> DataFrame:
    if tag not in SOURCE_TAGS:
        raise ValueError(f"unknown source tag {tag!r}")
    return df.withColumn("source", F.lit(tag))


def training_only(df: DataFrame) -> DataFrame:
    """The same rows; the job fails as soon as one of them is a scoring row."""
    refuse = F.raise_error(F.lit("scoring rows may not be used for fitting")).cast("boolean")
    return df.where(F.when(F.col("source") == "scoring", refuse).otherwise(F.lit(True)))


def forecast_origins(
    grid: DataFrame, last: int | None = None, listed: DataFrame | None = None, key: str = "series_id",
) -> DataFrame:
    """Origin slots (series, pos): an explicit list, the last N slots of each series, or every slot."""
    slots = grid.select(key, "pos").distinct()
    if listed is not None:
        return listed.select(key, "pos").distinct()
    if last is None:
        return slots
    ends = slots.groupBy(key).agg(F.max("pos").alias("_end"))
    return slots.join(ends, key).where(F.col("pos") > F.col("_end") - last).drop("_end")


def write_checked(df: DataFrame, path: str, rules, kind: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Write a table only if it keeps its rules, read it back and check the stored copy again.

    ``rules`` maps a table to its report (check, broken, status); returns the reader of the stored table.
    """
    from slotwise.plans.contracts import require_zero

    require_zero(rules(df).where("status = 'failed'"), "table breaks its contract before writing")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
    spark = df.sparkSession
    stored = (spark.read.option("header", True).schema(schema or df.schema).csv(path) if kind == "csv" else spark.read.parquet(path))
    require_zero(rules(stored).where("status = 'failed'"), "stored table breaks its contract")
    return stored


def feature_family(names: Sequence[str], family: str, target: str | None = None) -> list[str]:
    """Names of a feature family: everything, the target's own features, or a compact set."""
    if family == "all":
        return list(names)
    own = [n for n in names if target and (f"_{target}" in n)]
    if family == "target":
        return own
    if family == "compact":
        short = ("_current_", "_diff_", "_accel_", "_lag_", "feat_time_", "feat_state_")
        return [n for n in names if n.startswith("feat_time_") or (n in own and any(k in n for k in short))]
    raise ValueError(f"unknown feature family {family!r}")
