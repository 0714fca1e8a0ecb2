"""Scoring, rescoring and ranking of the current photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumarank.constants import AESTHETIC_SOURCE, ALL_DIMS, EXPOSURE_FIELDS, EXPOSURE_PROFILES, SCENE_WEIGHTS, VISION_DIMS
from lumarank.functions import scoring as S
from lumarank.operators import ranking as R
from lumarank.plans.catalog import query
from lumarank.plans.common import CUR, case_map, current, r, rs
from lumarank.runtime import cut, half_up, reported

SCORES = [f"score_{d}" for d in ALL_DIMS]
#: States in which a photo has scores that are computed again.
SCORED_STATUS = ("done", "scored")

# --- wide legacy scores to signals ------------------------------------------------------


def wide_signals(rows: DataFrame) -> DataFrame:
    """Signals of a photo from its stored scores, as columns."""
    rows = rows.withColumn("focus_integrity", S.mean_of_known(F.col("score_sharpness"), F.col("score_clarity")))
    rows = rows.withColumn("technical_quality", S.mean_of_known(F.col("score_exposure"), F.col("focus_integrity"), F.col("score_clarity"), F.col("score_clarity")))
    # a clarity of 0 counts as missing here
    prior = F.coalesce(F.when(F.col("score_clarity") != 0, F.col("score_clarity")), F.col("score_sharpness"))
    rows = rows.withColumn("subject_focus", F.col("focus_integrity")).withColumn("screening_prior", prior)
    for dim, source in AESTHETIC_SOURCE.items():
        rows = rows.withColumn(dim, F.col(f"score_{source}"))
    return rows.drop("focus_integrity")


SIGNALS = {"technical_quality": "technical", "subject_focus": "aggregate", "screening_prior": "screening", **{d: "aesthetic" for d in AESTHETIC_SOURCE}}

_MEAN = lambda *xs: "(CASE WHEN " + " + ".join(f"({x} IS NOT NULL)::INT" for x in xs) + " > 0 THEN " + r("(" + " + ".join(f"coalesce({x}, 0)" for x in xs) + ") / (" + " + ".join(f"({x} IS NOT NULL)::INT" for x in xs) + ")", 2) + " END)"
WIDE = (
    CUR
    + f""", w0 AS (SELECT *, {_MEAN("score_sharpness", "score_clarity")} AS sig_subject_focus FROM cur),
w1 AS (SELECT *, {_MEAN("score_exposure", "sig_subject_focus", "score_clarity", "score_clarity")} AS sig_technical_quality,
  coalesce(CASE WHEN score_clarity <> 0 THEN score_clarity END, score_sharpness) AS sig_screening_prior,
  {", ".join(f"score_{s} AS sig_{d}" for d, s in AESTHETIC_SOURCE.items())} FROM w0)
"""
)


@query(
    "legacy_signals",
    WIDE
    + " UNION ALL ".join(
        f"SELECT file_path, '{stage}' AS stage, '{key}' AS signal_key, {r('sig_' + key)} AS value FROM w1 WHERE sig_{key} IS NOT NULL"
        for key, stage in SIGNALS.items()
    ),
)
def legacy_signals(spark: SparkSession, root: str) -> DataFrame:
    """Long signal table of every photo: one row per known signal."""
    wide = wide_signals(current(spark, root, *SCORES))
    entries = F.array(*[F.struct(F.lit(stage).alias("stage"), F.lit(key).alias("signal_key"), half_up(F.col(key), 4).alias("value")) for key, stage in SIGNALS.items()])
    return wide.select("file_path", F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("s")).select("file_path", "s.*")


@query(
    "signal_summary",
    WIDE
    + ", long AS ("
    + " UNION ALL ".join(f"SELECT '{stage}' AS stage, '{key}' AS signal_key, sig_{key} AS value FROM w1" for key, stage in SIGNALS.items())
    + f") SELECT stage, signal_key, count(value) AS known, {r('avg(value)')} AS mean_value, {r('min(value)')} AS low, {r('max(value)')} AS high FROM long GROUP BY ALL",
)
def signal_summary(spark: SparkSession, root: str) -> DataFrame:
    """Count, mean and range of every signal."""
    wide = wide_signals(current(spark, root, *SCORES))
    stack = ", ".join(f"'{stage}', '{key}', {key}" for key, stage in SIGNALS.items())
    long = wide.selectExpr(f"stack({len(SIGNALS)}, {stack}) AS (stage, signal_key, value)")
    return long.groupBy("stage", "signal_key").agg(
        F.count("value").alias("known"), half_up(F.avg("value"), 4).alias("mean_value"), half_up(F.min("value"), 4).alias("low"), half_up(F.max("value"), 4).alias("high")
    )


# --- layered summary, rescoring -----------------------------------------------------------

_AEST = list(AESTHETIC_SOURCE)
_W = {d: case_map("scene_key", {s: w[d] for s, w in S.AESTHETIC_WEIGHTS.items() if s != "default"}, repr(S.AESTHETIC_WEIGHTS["default"][d]) + "::DOUBLE") for d in _AEST}
_TERM = lambda d, x: f"CASE WHEN v_{d} IS NOT NULL AND ({_W[d]}) > 0 THEN {x} ELSE 0 END"
SUMMARY = (
    WIDE
    + f""", s0 AS (SELECT file_path, group_key, scene_key, {r("sig_technical_quality", 2)} AS v_tech, {r("sig_subject_focus", 2)} AS v_focus, {r("sig_screening_prior", 2)} AS v_prior,
  {", ".join(f"{r('sig_' + d, 2)} AS v_{d}" for d in _AEST)} FROM w1 WHERE status IN ('done', 'scored')),
s1 AS (SELECT *, coalesce(v_tech, 0) AS tech, coalesce(v_focus, v_tech, 0) AS focus, coalesce(v_prior, v_tech, 0) AS prior,
  coalesce({r("(" + " + ".join(_TERM(d, f"v_{d} * ({_W[d]})") for d in _AEST) + ") / nullif(" + " + ".join(_TERM(d, _W[d]) for d in _AEST) + ", 0)", 2)}, 0) AS aesthetic,
  list_sort(list_filter([{", ".join(f"v_{d}" for d in _AEST)}], lambda x: x IS NOT NULL AND x > 0)) AS low FROM s0),
s2 AS (SELECT *, {r("0.25 * tech + 0.15 * focus + 0.5 * aesthetic + 0.1 * prior", 2)} AS base,
  {r("CASE WHEN len(low) > 0 THEN 0.18 * greatest(0, 6.5 - low[1]) ELSE 0 END + CASE WHEN len(low) > 1 THEN 0.08 * greatest(0, 5.5 - low[2]) ELSE 0 END + 0.12 * greatest(0, 6 - tech) + 0.10 * greatest(0, 6 - focus)", 2)} AS penalty FROM s1),
s3 AS (SELECT *, {r("greatest(0, least(10, base - penalty))", 2)} AS total FROM s2),
s4 AS (SELECT *, greatest(0, least(5, floor(total / 2 + 0.5)))::INT AS stars,
  CASE WHEN tech < 1.5 OR focus < 1.5 THEN 'reject' WHEN total >= 7.5 THEN 'keep' WHEN total >= 5.5 THEN 'review' ELSE 'reject' END AS first_decision,
  (tech < 1.5)::INT + (focus < 1.5)::INT AS n_reasons FROM s3),
s5 AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY total DESC, file_path) AS rank, count(*) OVER (PARTITION BY group_key) AS size,
  bool_or(first_decision = 'keep' OR (first_decision = 'reject' AND n_reasons > 0)) OVER (PARTITION BY group_key) AS blocked FROM s4),
s6 AS (SELECT *, rank = 1 AND NOT blocked AND first_decision = 'reject' AS lifted FROM s5)
"""
)


def summarised(spark: SparkSession, root: str) -> DataFrame:
    rows = current(spark, root, *SCORES, "status").filter(F.col("status").isin(*SCORED_STATUS))
    return S.layered_summary(wide_signals(rows), "scene_key")


@query("layered_summary", SUMMARY + "SELECT file_path, scene_key, tech, focus, prior, aesthetic, base, penalty, total, stars, first_decision AS decision FROM s6")
def layered_summary(spark: SparkSession, root: str) -> DataFrame:
    """All layers of the score of every photo."""
    return summarised(spark, root).select("file_path", "scene_key", "tech", "focus", "prior", "aesthetic", "base", "penalty", "total", "stars", "decision")


@query(
    "rescore",
    SUMMARY + "SELECT file_path, group_key, total, stars, CASE WHEN lifted THEN 'review' ELSE first_decision END AS decision, n_reasons + lifted::INT AS n_reasons, rank, size FROM s6",
)
def rescore(spark: SparkSession, root: str) -> DataFrame:
    """Rescoring of the library: summary, group rule and fresh ranks."""
    rows = cut(summarised(spark, root).select("file_path", "group_key", "total", "stars", "decision", "reasons"))  # read by each group rule
    rows = R.best_of_group_reviewed(rows, ["group_key"], "total", ["file_path"])
    rows = R.ranked(rows, ["group_key"], "total", ["file_path"])
    return rows.select("file_path", "group_key", "total", "stars", "decision", F.size("reasons").alias("n_reasons"), "rank", "size")


def with_stored_signals(wide: DataFrame, signals: DataFrame) -> DataFrame:
    """Wide signals in which the stored ones of a photo take the place of those of its legacy scores.

    ``signals``: ``(file_path, signal_key, value)``. A photo with any stored value has those only, and
    a signal that isn't stored is missing then; null and NaN values don't count. One aggregation
    with map-side combine; of repeated keys the greatest value counts.
    """
    known = signals.filter(F.col("file_path").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    stored = known.groupBy(F.col("file_path").alias("__file")).agg(*[F.max(F.when(F.col("signal_key") == k, F.col("value"))).alias(f"__{k}") for k in SIGNALS])
    rows = wide.join(stored.hint("merge"), F.col("file_path") == F.col("__file"), "left")
    return rows.withColumns({k: F.when(F.col("__file").isNotNull(), F.col(f"__{k}")).otherwise(F.col(k)) for k in SIGNALS}).drop("__file", *[f"__{k}" for k in SIGNALS])


_STORED = SUMMARY.replace(WIDE, "").replace("FROM w1 WHERE", "FROM w2 WHERE")


@query(
    "rescore_stored",
    WIDE
    + """, n1 AS (SELECT file_path, count(*) AS n FROM (SELECT file_path, unnest(map_values(visible_breakdown)) AS v FROM cur) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY file_path),
w2 AS (SELECT w1.* REPLACE ("""
    + ", ".join(f"CASE WHEN n1.n > 0 THEN CASE WHEN NOT isnan(visible_breakdown['{k}']) THEN visible_breakdown['{k}'] END ELSE sig_{k} END AS sig_{k}" for k in SIGNALS)
    + ") FROM w1 LEFT JOIN n1 USING (file_path))"
    + _STORED
    + "SELECT file_path, scene_key, tech, focus, prior, aesthetic, total, stars, first_decision AS decision FROM s6",
)
def rescore_stored(spark: SparkSession, root: str) -> DataFrame:
    """Summary of every scored photo from its stored signals, else from those of its legacy scores."""
    rows = current(spark, root, *SCORES, "status", "visible_breakdown").filter(F.col("status").isin(*SCORED_STATUS))
    signals = rows.select("file_path", F.explode("visible_breakdown").alias("signal_key", "value"))
    out = S.layered_summary(with_stored_signals(wide_signals(rows.drop("visible_breakdown")), signals), "scene_key")
    return out.select("file_path", "scene_key", "tech", "focus", "prior", "aesthetic", "total", "stars", "decision")


@query("rescore_scene", SUMMARY + "SELECT file_path, total, stars, first_decision AS decision, w.group_rank AS kept_rank FROM s6 JOIN (SELECT file_path, group_rank FROM cur) w USING (file_path) WHERE scene_key = 'people'")
def rescore_scene(spark: SparkSession, root: str) -> DataFrame:
    """Rescoring of one scene: new scores, stored ranks, no group rule."""
    rows = S.layered_summary(wide_signals(current(spark, root, *SCORES, "group_rank", "status").filter((F.col("scene_key") == "people") & F.col("status").isin(*SCORED_STATUS))), "scene_key")
    return rows.select("file_path", "total", "stars", "decision", F.col("group_rank").alias("kept_rank"))


# --- aggregation of scorers ---------------------------------------------------------------

_V = {d: case_map("scene_key", {s: w[d] for s, w in SCENE_WEIGHTS.items() if s != "default"}, repr(SCENE_WEIGHTS["default"][d]) + "::DOUBLE") for d in VISION_DIMS}
_VT = lambda d, x: f"CASE WHEN score_{d} IS NOT NULL THEN {x} ELSE 0 END"
_PIX = r("(coalesce(score_exposure * 0.4, 0) + coalesce(score_sharpness * 0.6, 0)) / nullif((CASE WHEN score_exposure IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN score_sharpness IS NOT NULL THEN 0.6 ELSE 0 END)::DOUBLE, 0)", 2)


@query(
    "aggregate_scores",
    CUR
    + f""", a AS (SELECT file_path, {_PIX} AS weighted, CASE WHEN score_sharpness < 2 THEN 2.0 END AS cap,
  ({" + ".join(_VT(d, f"score_{d} * ({_V[d]})") for d in VISION_DIMS)}) / nullif({" + ".join(_VT(d, _V[d]) for d in VISION_DIMS)}, 0) AS vision FROM cur),
b AS (SELECT *, CASE WHEN weighted IS NULL THEN NULL WHEN cap IS NOT NULL THEN least(weighted, cap) ELSE weighted END AS pixel FROM a)
SELECT file_path, pixel, {r("vision", 2)} AS vision, {r("coalesce((pixel * 0.3 + vision * 0.7) / (0.3 + 0.7)::DOUBLE, vision, pixel, 0)", 2)} AS total FROM b""",
)
def aggregate_scores(spark: SparkSession, root: str) -> DataFrame:
    """Weighted mean of the pixel scorers with a floor rule, scene-weighted vision mean, both combined."""
    rows = current(spark, root, *SCORES)
    parts = F.filter(F.array(F.struct(F.col("score_exposure").alias("v"), F.lit(0.4).alias("w"), F.lit(0.0).alias("f")), F.struct(F.col("score_sharpness").alias("v"), F.lit(0.6).alias("w"), F.lit(2.0).alias("f"))), lambda x: x["v"].isNotNull())
    rows = rows.withColumn("parts", parts).withColumn("vision", S.scene_weighted({d: F.col(f"score_{d}") for d in VISION_DIMS}, F.col("scene_key"), SCENE_WEIGHTS))
    pixel = F.when(F.size("parts") > 0, S.weighted_mean(F.col("parts.v"), F.col("parts.w"), F.col("parts.f")))
    rows = rows.withColumn("pixel", pixel)
    return rows.select("file_path", "pixel", half_up(F.col("vision")).alias("vision"), S.combined_total(F.col("pixel"), F.col("vision")).alias("total"))


_E = {f: case_map("scene_key", {s: v[i] for s, v in EXPOSURE_PROFILES.items() if s != "default"}, repr(EXPOSURE_PROFILES["default"][i]) + "::DOUBLE") for i, f in enumerate(EXPOSURE_FIELDS)}


@query(
    "exposure_profiles",
    CUR
    + f""", e AS (SELECT file_path, underexpose_ratio AS sh, overexpose_ratio AS hi, score_depth / 20 AS p5, score_lighting / 10 AS p50, score_mood / 10 AS p95,
  {", ".join(f"{x} AS {f}" for f, x in _E.items())} FROM cur WHERE underexpose_ratio BETWEEN 0 AND 1 AND overexpose_ratio BETWEEN 0 AND 1 AND score_depth IS NOT NULL AND score_lighting IS NOT NULL AND score_mood IS NOT NULL)
SELECT file_path, {r('''CASE WHEN sh >= 0.98 OR hi >= 0.98 THEN 0 ELSE greatest(0, least(10,
  w_shadow * (CASE WHEN sh <= shadow_soft THEN 10 WHEN sh >= shadow_hard THEN 0 ELSE 10 * (1 - (sh - shadow_soft) / (shadow_hard - shadow_soft)) END)
  + w_highlight * (CASE WHEN hi <= highlight_soft THEN 10 WHEN hi >= highlight_hard THEN 0 ELSE 10 * (1 - (hi - highlight_soft) / (highlight_hard - highlight_soft)) END)
  + w_median * (CASE WHEN abs(p50 - median_target) >= median_tolerance THEN 0 ELSE 10 * (1 - abs(p50 - median_target) / median_tolerance) END)
  + w_span * (CASE WHEN greatest(0, p95 - p5) <= span_bad THEN 0 WHEN greatest(0, p95 - p5) >= span_good THEN 10 ELSE 10 * (greatest(0, p95 - p5) - span_bad) / (span_good - span_bad) END))) END''', 3)} AS exposure FROM e""",
)
def exposure_profiles(spark: SparkSession, root: str) -> DataFrame:
    """Exposure score by the scene's profile from clipping ratios and luminance percentiles."""
    rows = current(spark, root, "underexpose_ratio", "overexpose_ratio", "score_depth", "score_lighting", "score_mood")
    rows = rows.filter(F.col("underexpose_ratio").between(0, 1) & F.col("overexpose_ratio").between(0, 1) & F.col("score_depth").isNotNull() & F.col("score_lighting").isNotNull() & F.col("score_mood").isNotNull())
    score = S.exposure_score(F.col("underexpose_ratio"), F.col("overexpose_ratio"), F.col("score_depth") / 20, F.col("score_lighting") / 10, F.col("score_mood") / 10, F.col("scene_key"))
    return rows.select("file_path", half_up(score, 3).alias("exposure"))


@query(
    "sharpness_ramp",
    CUR
    + f""", v AS (SELECT file_path, group_key, laplacian_variance AS x, max(laplacian_variance) OVER (PARTITION BY group_key) AS top FROM cur WHERE laplacian_variance >= 0 AND isfinite(laplacian_variance))
SELECT file_path, {r("CASE WHEN x <= 50 THEN 0 WHEN x >= 1000 THEN 10 ELSE 10 * (x - 50) / 950 END", 3)} AS sharpness, {r("CASE WHEN x > 0 THEN greatest(0, least(10, 5 + 2.5 * log2(x / top))) ELSE 0 END", 3)} AS relative FROM v""",
)
def sharpness_ramp(spark: SparkSession, root: str) -> DataFrame:
    """Sharpness by the variance ramp, and relative to the sharpest of the group."""
    from pyspark.sql import Window

    x = F.col("laplacian_variance")
    rows = current(spark, root, "laplacian_variance").filter((x >= 0) & (x < float("inf")))
    rows = rows.withColumn("top", F.max(x).over(Window.partitionBy("group_key")))
    return rows.select("file_path", half_up(S.rising(x, 50, 1000), 3).alias("sharpness"), half_up(S.relative_focus(x, F.col("top")), 3).alias("relative"))


@query(
    "heuristic_dims",
    CUR
    + f""", h0 AS (SELECT file_path, score_lighting / 10 AS b, score_depth / 40 AS c, score_color / 20 AS sa, overexpose_ratio AS hi, underexpose_ratio AS sh, score_clarity / 100 AS e FROM cur
  WHERE score_lighting IS NOT NULL AND score_depth IS NOT NULL AND score_color IS NOT NULL AND score_clarity IS NOT NULL AND overexpose_ratio BETWEEN 0 AND 1 AND underexpose_ratio BETWEEN 0 AND 1),
h1 AS (SELECT *, greatest(0, least(10, 8 - 12 * abs(b - 0.48) - 15 * (hi + sh))) AS li, greatest(0, least(10, 4.5 + 8 * sa)) AS co, greatest(0, least(10, 3.5 + 45 * e + 8 * c)) AS cl,
  greatest(0, least(10, 5.8 + 6 * least(c, 0.25))) AS cp, greatest(0, least(10, 4.5 + 10 * c)) AS de FROM h0)
SELECT file_path, {r("greatest(0, least(10, 0.45 * cl + 0.35 * li + 1))", 2)} AS subject, {r("cp", 2)} AS composition, {r("li", 2)} AS lighting, {r("co", 2)} AS color, {r("cl", 2)} AS clarity, {r("de", 2)} AS depth, {r("(li + co + de) / 3", 2)} AS mood FROM h1""",
)
def heuristic_dims(spark: SparkSession, root: str) -> DataFrame:
    """Seven dimensions from six image statistics."""
    rows = current(spark, root, *SCORES, "overexpose_ratio", "underexpose_ratio")
    ok = F.col("overexpose_ratio").between(0, 1) & F.col("underexpose_ratio").between(0, 1)
    for d in ("lighting", "depth", "color", "clarity"):
        ok = ok & F.col(f"score_{d}").isNotNull()
    dims = S.heuristic_dims(F.col("score_lighting") / 10, F.col("score_depth") / 40, F.col("score_color") / 20, F.col("overexpose_ratio"), F.col("underexpose_ratio"), F.col("score_clarity") / 100)
    return rows.filter(ok).select("file_path", dims.alias("d")).select("file_path", "d.*")


@query(
    "screening_tiers",
    CUR
    + """SELECT CASE WHEN score_sharpness < 0.25 THEN 'blur_guard' WHEN (coalesce(score_exposure, 0) + coalesce(score_sharpness, 0)) / 2 < 2.5 THEN 'pixel_screen' WHEN screening_prior < 3 THEN 'fast_screen' ELSE 'full_scoring' END AS tier, count(*) AS photos
FROM cur GROUP BY ALL""",
)
def screening_tiers(spark: SparkSession, root: str) -> DataFrame:
    """Photos by the first guard that stops them before the costly stage."""
    rows = current(spark, root, *SCORES, "screening_prior")
    pixel = (F.coalesce("score_exposure", F.lit(0.0)) + F.coalesce("score_sharpness", F.lit(0.0))) / 2
    tier = S.first_true([(F.col("score_sharpness") < 0.25, "blur_guard"), (pixel < 2.5, "pixel_screen"), (F.col("screening_prior") < 3, "fast_screen")], "full_scoring")
    return rows.groupBy(tier.alias("tier")).agg(F.count("*").alias("photos"))


# --- groups -------------------------------------------------------------------------------


@query("group_rank", CUR + "SELECT file_path, group_key, row_number() OVER (PARTITION BY group_key ORDER BY total_score DESC NULLS LAST, file_path) AS rank, count(*) OVER (PARTITION BY group_key) AS size FROM cur")
def group_rank(spark: SparkSession, root: str) -> DataFrame:
    """Rank and size of every photo in its group."""
    return R.ranked(current(spark, root), ["group_key"], "total_score", ["file_path"]).select("file_path", "group_key", "rank", "size")


@query(
    "rank_changes",
    CUR
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY total_score DESC NULLS LAST, file_path) AS rank, count(*) OVER (PARTITION BY group_key) AS size FROM cur)
SELECT file_path, rank, size FROM k WHERE NOT (rank IS NOT DISTINCT FROM group_rank AND size IS NOT DISTINCT FROM group_size AND group_key IS NOT DISTINCT FROM group_id)""",
)
def rank_changes(spark: SparkSession, root: str) -> DataFrame:
    """Photos whose stored rank, size or group is out of date and must be written again."""
    rows = R.ranked(current(spark, root, "group_rank", "group_size"), ["group_key"], "total_score", ["file_path"])
    return rows.filter(R.changed_ranks(rows, "group_rank", "group_size", "group_id")).select("file_path", "rank", "size")


@query(
    "group_guard",
    CUR
    + f""", k AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY total_score DESC NULLS LAST, file_path) AS rank, max(total_score) OVER (PARTITION BY group_key) AS top FROM cur)
SELECT file_path, {r("CASE WHEN rank = 1 AND top < 6 THEN 6 ELSE total_score END")} AS guarded FROM k""",
)
def group_guard(spark: SparkSession, root: str) -> DataFrame:
    """Scores with the best of each weak group raised to a floor."""
    rows = R.guarded(current(spark, root), ["group_key"], "total_score", ["file_path"], 6.0)
    return rows.select("file_path", half_up(F.col("guarded"), 4).alias("guarded"))


@query("complete_groups", CUR + "SELECT group_key, bool_and(coalesce(status = 'done', false)) AS complete FROM cur GROUP BY ALL")
def complete_groups(spark: SparkSession, root: str) -> DataFrame:
    """Groups all of whose photos are done and which a later run skips."""
    return R.complete_groups(current(spark, root, "status"), ["group_key"], F.col("status") == "done")


@query("bests_by_group", CUR + f"SELECT group_key, arg_max(file_path, (total_score, file_path)) AS best, {r('max(total_score)')} AS top, {r('max(total_score) - min(total_score)')} AS spread FROM cur WHERE total_score IS NOT NULL GROUP BY ALL")
def bests_by_group(spark: SparkSession, root: str) -> DataFrame:
    """Best photo of each group by score, ties to the greater path, and the spread of scores."""
    rows = current(spark, root).filter(F.col("total_score").isNotNull())
    return rows.groupBy("group_key").agg(
        F.max_by("file_path", F.struct("total_score", "file_path")).alias("best"), half_up(F.max("total_score"), 4).alias("top"), half_up(F.max("total_score") - F.min("total_score"), 4).alias("spread")
    )


# --- dimensions ---------------------------------------------------------------------------


@query(
    "weak_dims_per_group",
    CUR
    + ", long AS ("
    + " UNION ALL ".join(f"SELECT group_key, {i} AS pos, '{d}' AS dim, score_{d} AS v FROM cur" for i, d in enumerate(VISION_DIMS))
    + f"""), m AS (SELECT group_key, pos, dim, {r('avg(v)')} AS mean_score FROM long WHERE v IS NOT NULL GROUP BY ALL)
SELECT group_key, dim, mean_score, k FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY mean_score, pos) AS k FROM m) WHERE k <= 2""",
)
def weak_dims_per_group(spark: SparkSession, root: str) -> DataFrame:
    """The two dimensions with the lowest mean in each group, ties by their fixed order."""
    rows = current(spark, root, *SCORES)
    # one pass of partial aggregation over seven columns, then seven rows per group
    means = rows.groupBy("group_key").agg(*[half_up(F.avg(f"score_{d}"), 4).alias(d) for d in VISION_DIMS])
    entries = F.filter(F.array(*[F.struct(F.col(d).alias("mean_score"), F.lit(i).alias("pos"), F.lit(d).alias("dim")) for i, d in enumerate(VISION_DIMS)]), lambda e: e["mean_score"].isNotNull())
    return means.select("group_key", F.posexplode(F.slice(F.array_sort(entries), 1, 2)).alias("k", "e")).select("group_key", "e.dim", "e.mean_score", (F.col("k") + 1).alias("k"))


@query(
    "ranked_dims",
    CUR
    + "SELECT file_path, list_transform(list_sort(list_filter(["
    + ", ".join(f"{{'v': score_{d}, 'i': {i}, 'n': '{d}'}}" for i, d in enumerate(VISION_DIMS))
    + "], lambda x: x.v IS NOT NULL))[1:3], lambda x: x.n)::VARCHAR AS lowest FROM cur",
)
def ranked_dims(spark: SparkSession, root: str) -> DataFrame:
    """Names of the three lowest dimensions of every photo."""
    rows = current(spark, root, *SCORES)
    low = R.lowest_values({d: F.col(f"score_{d}") for d in VISION_DIMS}, 3)
    return rows.select("file_path", F.concat(F.lit("["), F.array_join(low, ", "), F.lit("]")).alias("lowest"))


@query(
    "worst_breakdown",
    CUR
    + f""", e AS (SELECT file_path, unnest(map_entries(visible_breakdown)) AS e FROM cur WHERE visible_breakdown IS NOT NULL),
k AS (SELECT file_path, e.key AS name, e.value AS v, row_number() OVER (PARTITION BY file_path ORDER BY e.value, e.key) AS k FROM e WHERE e.value IS NOT NULL AND NOT isnan(e.value))
SELECT file_path, name, {r('v')} AS value, k FROM k WHERE k <= 4""",
)
def worst_breakdown(spark: SparkSession, root: str) -> DataFrame:
    """The four lowest values of each photo's visible breakdown."""
    rows = current(spark, root, "visible_breakdown")
    entries = F.transform(F.map_entries("visible_breakdown"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("name")))
    low = F.slice(F.array_sort(F.filter(entries, lambda e: e["v"].isNotNull() & ~F.isnan(e["v"]))), 1, 4)
    return rows.select("file_path", F.posexplode(low).alias("k", "e")).select("file_path", "e.name", half_up(F.col("e.v"), 4).alias("value"), (F.col("k") + 1).alias("k"))


_FAV = (4.0, 5.5, 6.5, 7.5, 8.5)


@query(
    "score_diversity",
    CUR
    + f""", v AS (SELECT file_path, group_key, {r('total_score', 2)} AS t, [{", ".join(f"floor(score_{d} * 10 + 0.5000001) / 10" for d in VISION_DIMS)}] AS x FROM cur),
whole AS (SELECT x, count(*) AS c FROM v WHERE len(list_filter(x, lambda y: y IS NULL)) = 0 GROUP BY x),
vals AS (SELECT unnest(x) AS y FROM v WHERE len(list_filter(x, lambda y: y IS NULL)) = 0),
g AS (SELECT group_key, max(t) - min(t) AS rng, count(t) AS n FROM v GROUP BY group_key)
SELECT (SELECT {r("max(t) - min(t)", 2)} FROM v) AS score_range, (SELECT {r("avg((y IN (4.0, 5.5, 6.5, 7.5, 8.5))::INT)", 3)} FROM vals) AS favourite_ratio,
  (SELECT {r("sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c)", 3)} FROM whole) AS repeated_ratio, (SELECT count(*) FROM whole) AS distinct_vectors,
  (SELECT count(*) FROM g WHERE n > 1) AS groups_of_many, (SELECT {rs("avg(rng)", 2)} FROM g WHERE n > 1) AS mean_group_range""",
)
def score_diversity(spark: SparkSession, root: str) -> DataFrame:
    """How varied scores are: range, favourite values, repeated vectors, ranges within groups."""
    rows = current(spark, root, *SCORES).select("group_key", half_up(F.col("total_score")).alias("t"), F.array(*[half_up(F.col(f"score_{d}"), 1) for d in VISION_DIMS]).alias("x"))
    whole = rows.filter(F.forall("x", lambda y: y.isNotNull()))
    favourites = F.size(F.filter("x", lambda y: y.isin(*_FAV)))
    vectors = whole.groupBy("x").agg(F.count("*").alias("c"), F.sum(favourites).alias("f")).agg(
        half_up(F.sum("f") / F.sum(F.col("c") * len(VISION_DIMS)), 3).alias("favourite_ratio"),
        half_up(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c"), 3).alias("repeated_ratio"),
        F.count("*").alias("distinct_vectors"),
    )
    groups = rows.groupBy("group_key").agg(F.max("t").alias("a"), F.min("t").alias("b"), F.count("t").alias("n"))
    per_group = groups.agg(
        half_up(F.max("a") - F.min("b")).alias("score_range"), F.count_if(F.col("n") > 1).alias("groups_of_many"), reported(F.avg(F.when(F.col("n") > 1, F.col("a") - F.col("b")))).alias("mean_group_range")
    )
    both = per_group.unionByName(vectors, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query("score_histogram", CUR + f"SELECT coalesce(decision, 'none') AS decision, scene_key, count(*) AS photos, {r('min(total_score)')} AS low, {r('avg(total_score)')} AS mean, {r('max(total_score)')} AS high FROM cur GROUP BY ALL")
def score_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Counts and score statistics per decision and scene."""
    rows = current(spark, root, "decision")
    t = F.col("total_score")
    return rows.groupBy(F.coalesce("decision", F.lit("none")).alias("decision"), "scene_key").agg(
        F.count("*").alias("photos"), half_up(F.min(t), 4).alias("low"), half_up(F.avg(t), 4).alias("mean"), half_up(F.max(t), 4).alias("high")
    )


@query(
    "signals_or_legacy",
    WIDE
    + """, stored AS (SELECT file_path, unnest(map_entries(visible_breakdown)) AS e FROM cur WHERE visible_breakdown IS NOT NULL), s AS (SELECT file_path, count(*) AS n FROM stored WHERE e.value IS NOT NULL AND NOT isnan(e.value) GROUP BY file_path)
SELECT w1.file_path, CASE WHEN s.n > 0 THEN 'stored' ELSE 'legacy' END AS origin, CASE WHEN s.n > 0 THEN s.n ELSE """
    + " + ".join(f"(sig_{k} IS NOT NULL)::INT" for k in SIGNALS)
    + " END AS signals FROM w1 LEFT JOIN s ON s.file_path = w1.file_path",
)
def signals_or_legacy(spark: SparkSession, root: str) -> DataFrame:
    """Where a photo's signals come from: the stored ones, else those of its legacy scores."""
    rows = wide_signals(current(spark, root, *SCORES, "visible_breakdown"))
    stored = F.size(F.filter(F.map_values("visible_breakdown"), lambda v: v.isNotNull() & ~F.isnan(v)))
    stored = F.when(F.col("visible_breakdown").isNotNull(), stored).otherwise(0)
    legacy = sum((F.col(k).isNotNull().cast("int") for k in SIGNALS), F.lit(0))
    return rows.select("file_path", F.when(stored > 0, "stored").otherwise("legacy").alias("origin"), F.when(stored > 0, stored).otherwise(legacy).alias("signals"))
