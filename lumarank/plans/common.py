"""Tables in the shape the queries share, and the matching SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumarank.constants import ALL_DIMS, SCENES
from lumarank.operators.ranking import latest_rows
from lumarank.runtime import strip_blanks, table

BLANKS = r"'^[\s\x{00a0}\x{3000}]+|[\s\x{00a0}\x{3000}]+$', '', 'g'"


TIE_KEYS = ("technical_quality", "composition", "lighting")


def r(x: str, digits: int = 4) -> str:
    """SQL of the rounding of scores (two places), else of reported values."""
    if digits != 2:
        return rs(x, digits)
    error = "((v * 134217729 - (v * 134217729 - v)) * 100 - v * 100) + (v - (v * 134217729 - (v * 134217729 - v))) * 100"
    part = "v * 100 - floor(v * 100)"
    up = f"CASE WHEN {part} <> 0.5 THEN {part} > 0.5 WHEN {error} <> 0 THEN {error} > 0 ELSE floor(v * 100) % 2 <> 0 END"
    return f"(list_transform([({x})::DOUBLE], lambda v: (floor(v * 100) + ({up})::INT) / 100)[1])"


def rs(x: str, digits: int = 4) -> str:
    """SQL of the rule for reported values."""
    return f"(floor(({x}) * 1e{digits} + 0.5000001) / 1e{digits})"


def usable(column: str):
    """A score that is a number from 0 to 10, else null."""
    c = F.col(column)
    return F.when((c >= 0) & (c <= 10), c)


def usable_sql(column: str) -> str:
    return f"CASE WHEN {column} >= 0 AND {column} <= 10 THEN {column} END"


def current(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Current rows of processed with cleaned scores, scene and group.

    ``group_key`` is the normalised group_id, the path itself for photos without a group.
    """
    need = {"file_path", "processed_at", "total_score", "group_id", "scene", *columns}
    rows = table(spark, root, "processed").select(*[c for c in table(spark, root, "processed").columns if c in need]).filter(F.col("file_path").isNotNull())
    # runs of one moment differ in nothing but the breakdown, where it is wanted
    ties = [F.try_element_at("visible_breakdown", F.lit(k)) for k in TIE_KEYS] if "visible_breakdown" in rows.columns else []
    rows = latest_rows(rows, ["file_path"], [F.col("processed_at"), F.col("total_score"), *ties])
    for c in ("total_score", *[f"score_{d}" for d in ALL_DIMS]):
        if c in rows.columns:
            rows = rows.withColumn(c, usable(c))
    scene = F.lower(F.trim("scene"))
    group = F.lower(strip_blanks(F.col("group_id")))
    return rows.withColumn("scene_key", F.when(scene.isin(*SCENES), scene).otherwise("default")).withColumn("group_key", F.coalesce(F.nullif(group, F.lit("")), F.col("file_path")))


CUR = f"""WITH cur0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY processed_at DESC NULLS LAST, total_score DESC NULLS LAST,
  {", ".join(f"visible_breakdown['{k}'] DESC NULLS LAST" for k in TIE_KEYS)}) AS rn
  FROM processed WHERE file_path IS NOT NULL) WHERE rn = 1),
cur AS (SELECT * REPLACE ({", ".join(f"{usable_sql(c)} AS {c}" for c in ("total_score", *[f"score_{d}" for d in ALL_DIMS]))}),
  CASE WHEN lower(trim(scene)) IN ({", ".join(f"'{s}'" for s in SCENES)}) THEN lower(trim(scene)) ELSE 'default' END AS scene_key,
  coalesce(nullif(lower(regexp_replace(group_id, {BLANKS})), ''), file_path) AS group_key FROM cur0)
"""


def case_map(key: str, values: dict[str, float], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in values.items()) + f" ELSE {default} END"
