"""Human labels: validation, splits and calibration fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumarank.functions.scoring import calibrated, clamp

PIVOT = 5.5


def valid_labels(labels: DataFrame) -> DataFrame:
    """``(label_id, path, target, raw_score, human, split, source)`` of rows that can be used.

    target and split are normalised; human is human_score, else twice human_rating; both scores
    are from 1 to 10. Repeated rows count once.
    """
    text = lambda c: F.lower(F.trim(c))
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    human = F.coalesce(known("human_score"), known("human_rating") * 2)
    rows = labels.select("label_id", "path", text("target").alias("target"), "raw_score", human.alias("human"), text("split").alias("split"), "source")
    return rows.filter(F.col("raw_score").between(1, 10) & F.col("human").between(1, 10) & (F.col("target") != "")).dropDuplicates(["label_id"])


def calibration_fit(rows: DataFrame, keys: list[str], min_labels: int = 20, min_span: float = 0.1) -> DataFrame:
    """Affine fit of human on raw score per key: clipped slope and intercept, errors before and after, status.

    One aggregation of moments per key; the error after the fit needs a second pass over the
    rows, which the per-key result (as many rows as keys) is joined to.
    """
    x, y = F.col("raw_score") - PIVOT, F.col("human") - PIVOT
    slope = F.when(F.max("raw_score") > F.min("raw_score"), F.regr_slope(y, x))
    fits = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.max("raw_score") - F.min("raw_score")).alias("span"),
        clamp(slope, 0.5, 1.5).alias("scale"),
        slope.alias("__slope"),
        F.avg(x).alias("__mx"),
        F.avg(y).alias("__my"),
    )
    fits = fits.withColumn("offset", clamp(F.col("__my") - F.col("__slope") * F.col("__mx"), -2.0, 2.0)).drop("__mx", "__my", "__slope")
    joined = rows.join(fits, keys)
    after = calibrated(F.col("raw_score"), F.col("scale"), F.col("offset"))
    errors = joined.groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow(F.col("human") - F.col("raw_score"), 2))).alias("rmse_before"), F.sqrt(F.avg(F.pow(F.col("human") - after, 2))).alias("rmse_after")
    )
    status = (
        F.when(F.col("n") < min_labels, "insufficient_labels")
        .when(F.col("span") < min_span, "insufficient_raw_span")
        .when(F.col("rmse_after") < F.col("rmse_before") - 1e-9, "fitted")
        .otherwise("no_improvement")
    )
    return fits.join(errors, keys).withColumn("status", status)


def first_profile(candidates: list[Column], counts: list[Column], least: int) -> Column:
    """The first candidate (in order) with enough labels, else the first that exists, else null."""
    entries = F.filter(F.array(*[F.when(c.isNotNull(), F.struct(c.alias("p"), n.alias("n"))) for c, n in zip(candidates, counts)]), lambda e: e.isNotNull())
    enough = F.filter(entries, lambda e: e["n"] >= least)
    return F.coalesce(F.try_element_at(enough, F.lit(1))["p"], F.try_element_at(entries, F.lit(1))["p"])
