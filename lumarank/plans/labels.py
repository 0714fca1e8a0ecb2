"""Human labels and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumarank.functions.scoring import calibrated
from lumarank.operators import labels as L
from lumarank.plans.catalog import query
from lumarank.plans.common import CUR, current
from lumarank.plans.common import rs as r
from lumarank.runtime import table
from lumarank.runtime import reported as half_up

_VALID = """WITH lab AS (SELECT * FROM (SELECT label_id, path, lower(trim(target)) AS target, raw_score,
  coalesce(CASE WHEN NOT isnan(human_score) THEN human_score END, CASE WHEN NOT isnan(human_rating) THEN human_rating * 2 END) AS human, lower(trim(split)) AS split, source,
  row_number() OVER (PARTITION BY label_id ORDER BY path) AS k FROM aesthetic_labels) WHERE k = 1 AND raw_score BETWEEN 1 AND 10 AND human BETWEEN 1 AND 10 AND target <> '')
"""


def valid(spark: SparkSession, root: str) -> DataFrame:
    return L.valid_labels(table(spark, root, "aesthetic_labels"))


@query("valid_labels", _VALID + f"SELECT label_id, target, {r('raw_score')} AS raw_score, {r('human')} AS human, split FROM lab")
def valid_labels(spark: SparkSession, root: str) -> DataFrame:
    """Usable labels in their normalised form."""
    return valid(spark, root).select("label_id", "target", half_up(F.col("raw_score"), 4).alias("raw_score"), half_up(F.col("human"), 4).alias("human"), "split")


@query("label_stats", _VALID + "SELECT target, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'holdout') AS holdout, count(*) AS total FROM lab GROUP BY ROLLUP (target)")
def label_stats(spark: SparkSession, root: str) -> DataFrame:
    """Labels per target and split, with the grand total as a row of its own."""
    return valid(spark, root).rollup("target").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "holdout").alias("holdout"), F.count("*").alias("total"))


@query("label_pivot", _VALID + "SELECT source, coalesce(sum((split = 'train')::INT), 0)::BIGINT AS train, coalesce(sum((split = 'holdout')::INT), 0)::BIGINT AS holdout FROM lab GROUP BY source")
def label_pivot(spark: SparkSession, root: str) -> DataFrame:
    """Labels per source, one column per split."""
    counts = valid(spark, root).groupBy("source").pivot("split", ["train", "holdout"]).count()
    return counts.select("source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("train", "holdout")])


@query("split_assignment", "WITH p AS (SELECT DISTINCT path FROM aesthetic_labels WHERE path IS NOT NULL) SELECT path, CASE WHEN ('0x' || substr(sha256(path), 1, 8))::BIGINT % 100 < 20 THEN 'holdout' ELSE 'train' END AS split FROM p")
def split_assignment(spark: SparkSession, root: str) -> DataFrame:
    """The split that a path's hash assigns."""
    from lumarank.functions.identity import split_name

    p = F.col("path")
    return table(spark, root, "aesthetic_labels", ["path"]).filter(p.isNotNull()).distinct().select(p, split_name(p).alias("split"))


_FIT = (
    _VALID
    + """, m AS (SELECT target, count(*) AS n, max(raw_score) - min(raw_score) AS span, CASE WHEN max(raw_score) > min(raw_score) THEN regr_slope(human - 5.5, raw_score - 5.5) END AS slope, avg(human - 5.5::DOUBLE) AS my, avg(raw_score - 5.5::DOUBLE) AS mx FROM lab GROUP BY target),
f AS (SELECT *, CASE WHEN slope IS NOT NULL THEN greatest(0.5, least(1.5, slope)) END AS scale, CASE WHEN slope IS NOT NULL THEN greatest(-2, least(2, my - slope * mx)) END AS offs FROM m),
e AS (SELECT target, sqrt(avg((human - raw_score) ** 2)) AS before, sqrt(avg((human - CASE WHEN scale IS NOT NULL THEN greatest(1, least(10, raw_score + 1.0 * (greatest(1, least(10, 5.5 + scale * (raw_score - 5.5) + offs)) - raw_score))) END) ** 2)) AS after FROM lab JOIN f USING (target) GROUP BY target),
fit AS (SELECT *, CASE WHEN n < 20 THEN 'insufficient_labels' WHEN span < 0.1 THEN 'insufficient_raw_span' WHEN after < before - 1e-9 THEN 'fitted' ELSE 'no_improvement' END AS status FROM f JOIN e USING (target))
"""
)


@query("calibration_fit", _FIT + f"SELECT target, n, {r('scale')} AS scale, {r('offs')} AS \"offset\", {r('before')} AS rmse_before, {r('after')} AS rmse_after, status FROM fit")
def calibration_fit(spark: SparkSession, root: str) -> DataFrame:
    """Affine calibration of every target."""
    fit = L.calibration_fit(valid(spark, root), ["target"])
    return fit.select("target", "n", *[half_up(F.col(c), 4).alias(c) for c in ("scale", "offset", "rmse_before", "rmse_after")], "status")


@query(
    "calibrated_scores",
    CUR
    + _FIT.replace("WITH lab", ", lab", 1)
    + f""", pr AS (SELECT target, scale, offs, n FROM fit WHERE status = 'fitted'), ov AS (SELECT scale, offs FROM pr WHERE target = 'overall'),
j AS (SELECT file_path, total_score, coalesce(pr.scale, (SELECT scale FROM ov)) AS scale, coalesce(pr.offs, (SELECT offs FROM ov)) AS offs,
  CASE WHEN pr.target IS NOT NULL THEN 'scene' WHEN (SELECT count(*) FROM ov) > 0 THEN 'default' ELSE 'no_profile' END AS profile
  FROM cur LEFT JOIN pr ON pr.target = CASE scene_key WHEN 'people' THEN 'person' WHEN 'city' THEN 'building' WHEN 'landscape' THEN 'mountain' WHEN 'animals' THEN 'dog' ELSE 'none' END WHERE total_score >= 1)
SELECT file_path, profile, {r("CASE WHEN scale IS NULL THEN total_score ELSE greatest(1, least(10, total_score + 0.8 * (greatest(1, least(10, 5.5 + scale * (total_score - 5.5) + offs)) - total_score))) END")} AS calibrated FROM j""",
)
def calibrated_scores(spark: SparkSession, root: str) -> DataFrame:
    """Scores corrected by the profile of the scene's target, else by the default one."""
    fit = L.calibration_fit(valid(spark, root), ["target"]).filter(F.col("status") == "fitted").select("target", "scale", "offset")
    # one row at most: fits are one per target
    default = fit.filter(F.col("target") == "overall").select(F.col("target").alias("fallback"), F.col("scale").alias("d_scale"), F.col("offset").alias("d_offset")).limit(1)
    scene = F.col("scene_key")
    target = F.when(scene == "people", "person").when(scene == "city", "building").when(scene == "landscape", "mountain").when(scene == "animals", "dog").otherwise("none")
    rows = current(spark, root).filter(F.col("total_score") >= 1).withColumn("target", target).join(fit, "target", "left")
    rows = rows.withColumn("fallback", F.lit("overall")).join(F.broadcast(default), "fallback", "left")
    scale, offset = F.coalesce("scale", "d_scale"), F.coalesce("offset", "d_offset")
    profile = F.when(F.col("scale").isNotNull(), "scene").when(F.col("d_scale").isNotNull(), "default").otherwise("no_profile")
    value = F.when(scale.isNull(), F.col("total_score")).otherwise(calibrated(F.col("total_score"), scale, offset, blend=0.8))
    return rows.select("file_path", profile.alias("profile"), half_up(value, 4).alias("calibrated"))


@query(
    "label_conflicts",
    _VALID + f"SELECT path, target, count(*) AS labels, {r('max(human) - min(human)')} AS spread FROM lab GROUP BY ALL HAVING count(*) > 1",
)
def label_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """Paths labelled more than once for a target and how far their labels differ."""
    rows = valid(spark, root).groupBy("path", "target").agg(F.count("*").alias("labels"), half_up(F.max("human") - F.min("human"), 4).alias("spread"))
    return rows.filter(F.col("labels") > 1)


@query(
    "latest_labels",
    """SELECT path, target, label_id FROM (SELECT *, row_number() OVER (PARTITION BY path, target ORDER BY updated_at DESC NULLS LAST, label_id DESC) AS k FROM (SELECT DISTINCT path, target, label_id, updated_at FROM aesthetic_labels)) WHERE k = 1""",
)
def latest_labels(spark: SparkSession, root: str) -> DataFrame:
    """The label that an import with conflict update leaves per path and target."""
    rows = table(spark, root, "aesthetic_labels", ["path", "target", "label_id", "updated_at"])
    return rows.groupBy("path", "target").agg(F.max(F.struct("updated_at", "label_id"))["label_id"].alias("label_id"))
