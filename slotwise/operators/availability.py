"""Which field may feed which feature at forecast time.

The registry is a small dimension table, one row per field. A feature declares its source
fields and their offsets; a feature is emitted only if every declared use is allowed.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_SCHEMA = (
    "field string, source_file string, available_at_origin boolean, min_lag_steps int, is_label boolean, "
    "is_plan boolean, allow_short boolean, allow_long boolean, pending string, collection_delay_steps int, "
    "known_ahead_steps int"
)


@dataclass(frozen=True)
class FieldRule:
    """Availability of one field; an unlisted field is denied."""

    field: str
    source_file: str = ""
    available_at_origin: bool = False
    min_lag_steps: int = 0
    is_label: bool = False
    is_plan: bool = False
    allow_short: bool = False
    allow_long: bool = False
    pending: str = ""
    collection_delay_steps: int = 0
    known_ahead_steps: int = 0


@dataclass(frozen=True)
class FieldUse:
    feature: str
    field: str
    offset: int
    scope: str = "long"


def registry_table(spark: SparkSession, rules: Iterable[FieldRule]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(r).values()) for r in rules], REGISTRY_SCHEMA)


def usage_table(spark: SparkSession, uses: Iterable[FieldUse]) -> DataFrame:
    return spark.createDataFrame(
        [(u.feature, u.field, u.offset, u.scope) for u in uses],
        "feature string, field string, offset int, scope string")


def scope_allowed(scope: Column) -> Column:
    flag = F.when(scope == "short", F.col("allow_short")).when(scope == "long", F.col("allow_long"))
    return F.coalesce(F.col("available_at_origin") & flag, F.lit(False))


def first_objection(scope: Column, offset: Column) -> Column:
    """Null when the use is allowed, else the first rule it breaks."""
    arrival = offset + F.coalesce("collection_delay_steps", F.lit(0)) - F.coalesce("known_ahead_steps", F.lit(0))
    return (
        F.when(~scope.isin("short", "long"), "unknown scope")
        .when(~scope_allowed(scope), "not allowed in scope")
        .when(offset > -F.coalesce("min_lag_steps", F.lit(0)), "lag too short")
        .when(arrival > 0, "not yet available at origin")
    )


def judge(uses: DataFrame, registry: DataFrame) -> DataFrame:
    """Every use with its objection, null meaning allowed."""
    joined = uses.join(registry, "field", "left")
    return joined.select(*uses.columns, first_objection(F.col("scope"), F.col("offset")).alias("objection"))


def allowed_features(uses: DataFrame, registry: DataFrame) -> DataFrame:
    """Features none of whose uses is objected to."""
    verdicts = judge(uses, registry).groupBy("feature").agg(F.count("objection").alias("objections"))
    return verdicts.where("objections = 0").select("feature")


def select_allowed(frame: DataFrame, uses: Sequence[FieldUse], rules: Iterable[FieldRule],
                   keep: Sequence[str] = ("series_id", "pos")) -> DataFrame:
    """Project a feature frame to its keys and the features the registry lets through.

    The verdicts are as many as the frame has columns, so the list fits the driver.
    """
    spark = frame.sparkSession
    allowed = {
        r.feature for r in allowed_features(usage_table(spark, uses), registry_table(spark, rules)).collect()}
    lineage = {u.feature for u in uses}
    unknown = [c for c in frame.columns if c not in keep and c not in lineage]
    if unknown:
        raise ValueError(f"features without lineage: {unknown[:5]}")
    return frame.select(*keep, *[c for c in frame.columns if c in allowed])


def open_fields(registry: DataFrame, scope: str) -> DataFrame:
    return registry.where(scope_allowed(F.lit(scope))).select("field")


def inventory(fields: DataFrame, registry: DataFrame) -> DataFrame:
    """Registration and flags of every data field; unknown fields show as denied."""
    known = registry.withColumn("_known", F.lit(True))
    flags = ("available_at_origin", "allow_short", "allow_long", "is_label", "is_plan")
    return fields.join(known, "field", "left").select(
        "field", F.coalesce("_known", F.lit(False)).alias("registered"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in flags], F.coalesce("pending", F.lit("")).alias("pending"))


def rules_from(mapping: Mapping[str, Mapping]) -> list[FieldRule]:
    """Rules out of a plain nested mapping (field -> properties)."""
    known = FieldRule.__dataclass_fields__
    return [FieldRule(field=name, **{k: v for k, v in entry.items() if k in known}) for name, entry in mapping.items()]
