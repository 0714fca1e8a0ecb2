"""Benchmark and model metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumarank.functions.scoring import cosine, quality_metric, softmax, unit_vector
from lumarank.operators import benchmark as B
from lumarank.plans.catalog import query
from lumarank.plans.common import CUR, current
from lumarank.plans.common import rs as r
from lumarank.runtime import table
from lumarank.runtime import reported as half_up

_ATT = """WITH att AS (SELECT * REPLACE (lower(trim(model)) AS model, CASE WHEN latency_ms > 0 AND isfinite(latency_ms) THEN latency_ms END AS latency_ms)
  FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY run_id) AS rn FROM attempts WHERE attempt_id IS NOT NULL) WHERE rn = 1)
"""


def attempts(spark: SparkSession, root: str) -> DataFrame:
    return B.clean_attempts(table(spark, root, "attempts"))


@query(
    "attempt_summary",
    _ATT
    + f""", f AS (SELECT model, task, string_agg(e, '; ' ORDER BY k) AS failures FROM (SELECT model, task, coalesce(error, '') AS e, row_number() OVER (PARTITION BY model, task ORDER BY attempt_id) AS k FROM att WHERE NOT schema_success) WHERE k <= 3 GROUP BY ALL),
s AS (SELECT model, task, count(*) AS attempts, {r('avg(json_success::INT)')} AS json_rate, {r('avg(schema_success::INT)')} AS schema_rate, {r('avg(latency_ms)', 2)} AS mean_latency_ms, {r('avg(quality.average)', 2)} AS mean_quality FROM att GROUP BY ALL)
SELECT s.*, failures FROM s LEFT JOIN f ON s.model IS NOT DISTINCT FROM f.model AND s.task IS NOT DISTINCT FROM f.task""",
)
def attempt_summary(spark: SparkSession, root: str) -> DataFrame:
    """Success rates, latency, quality and first failures per model and task."""
    rows = B.summary_of_attempts(attempts(spark, root), ["model", "task"])
    two = lambda c: half_up(F.col(c)).alias(c)
    return rows.select("model", "task", "attempts", half_up(F.col("json_rate"), 4).alias("json_rate"), half_up(F.col("schema_rate"), 4).alias("schema_rate"), two("mean_latency_ms"), two("mean_quality"), "failures")


@query("mean_of_task_means", _ATT + f", t AS (SELECT model, task, avg(latency_ms) AS m, avg(schema_success::INT) AS s FROM att GROUP BY ALL) SELECT model, {r('avg(m)', 2)} AS mean_latency_ms, {r('avg(s)')} AS schema_rate, count(*) AS tasks FROM t GROUP BY model")
def mean_of_task_means(spark: SparkSession, root: str) -> DataFrame:
    """Models by the mean of their task means, so that frequent tasks don't outweigh others."""
    tasks = attempts(spark, root).groupBy("model", "task").agg(F.avg("latency_ms").alias("m"), F.avg(F.col("schema_success").cast("double")).alias("s"))
    return tasks.groupBy("model").agg(half_up(F.avg("m")).alias("mean_latency_ms"), half_up(F.avg("s"), 4).alias("schema_rate"), F.count("*").alias("tasks"))


@query(
    "first_and_later",
    _ATT + f"SELECT model, run_id, {r('arg_min(latency_ms, (iteration, attempt_id))', 2)} AS first_ms, {r('avg(CASE WHEN iteration > 1 THEN latency_ms END)', 2)} AS later_ms, {r('arg_min(latency_ms, (iteration, attempt_id)) / avg(CASE WHEN iteration > 1 THEN latency_ms END)', 3)} AS speed_up FROM att WHERE latency_ms IS NOT NULL GROUP BY ALL",
)
def first_and_later(spark: SparkSession, root: str) -> DataFrame:
    """First against later latencies of every model and run."""
    rows = attempts(spark, root).filter(F.col("latency_ms").isNotNull()).groupBy("model", "run_id").agg(
        F.min_by("latency_ms", F.struct("iteration", "attempt_id")).alias("a"), F.avg(F.when(F.col("iteration") > 1, F.col("latency_ms"))).alias("b")
    )
    return rows.select("model", "run_id", half_up(F.col("a")).alias("first_ms"), half_up(F.col("b")).alias("later_ms"), half_up(F.col("a") / F.col("b"), 3).alias("speed_up"))


@query(
    "best_candidates",
    _ATT
    + f""", c AS (SELECT model, candidate.contract_mode AS mode, candidate.prompt_preset AS preset, candidate.image_max_edge AS edge, {r('avg(schema_success::INT)')} AS rate, {r('avg(quality.average)', 2)} AS quality, {r('avg(latency_ms)', 2)} AS ms FROM att GROUP BY ALL)
SELECT model, mode, preset, edge, rate, quality, ms FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rate DESC, quality DESC NULLS LAST, ms ASC NULLS LAST, mode, preset, edge) AS k FROM c) WHERE k = 1""",
)
def best_candidates(spark: SparkSession, root: str) -> DataFrame:
    """The best parameter set of every model: success, then quality, then speed."""
    c = F.col("candidate")
    rows = attempts(spark, root).groupBy("model", c["contract_mode"].alias("mode"), c["prompt_preset"].alias("preset"), c["image_max_edge"].alias("edge")).agg(
        half_up(F.avg(F.col("schema_success").cast("double")), 4).alias("rate"), half_up(F.avg("quality.average")).alias("quality"), half_up(F.avg("latency_ms")).alias("ms")
    )
    order = [F.desc("rate"), F.desc_nulls_last("quality"), F.asc_nulls_last("ms"), "mode", "preset", "edge"]
    k = F.row_number().over(Window.partitionBy("model").orderBy(*order))
    return rows.withColumn("k", k).filter(F.col("k") == 1).drop("k")


@query("latency_profile", _ATT + f"SELECT task, count(*) AS attempts, {r('median(latency_ms)', 2)} AS median_ms, {r('quantile_cont(latency_ms, 0.95)', 2)} AS p95_ms, {r('1000.0::DOUBLE * count(*) / sum(latency_ms)')} AS per_second FROM att WHERE latency_ms IS NOT NULL GROUP BY task")
def latency_profile(spark: SparkSession, root: str) -> DataFrame:
    """Exact median and 95th percentile and the throughput per task."""
    rows = attempts(spark, root).filter(F.col("latency_ms").isNotNull())
    return rows.groupBy("task").agg(
        F.count("*").alias("attempts"), half_up(F.median("latency_ms")).alias("median_ms"), half_up(F.percentile("latency_ms", F.lit(0.95))).alias("p95_ms"), half_up(1000.0 * F.count("*") / F.sum("latency_ms"), 4).alias("per_second")
    )


@query(
    "timing_dedupe",
    _ATT + f", p AS (SELECT run_id, min(latency_ms) AS inference_ms, max(iteration) AS compile_ms FROM att WHERE run_id IS NOT NULL GROUP BY run_id) SELECT count(*) AS runs, {r('sum(inference_ms)', 2)} AS inference_ms, max(compile_ms) AS compile_ms FROM p",
)
def timing_dedupe(spark: SparkSession, root: str) -> DataFrame:
    """Timings with every inference run counted once."""
    rows = attempts(spark, root).select("run_id", F.col("latency_ms").alias("inference_ms"), F.col("iteration").alias("compile_ms"))
    return B.deduplicated_timings(rows, "run_id", ["inference_ms"], "compile_ms").select("runs", half_up(F.col("inference_ms")).alias("inference_ms"), "compile_ms")


@query("stable_outputs", _ATT + "SELECT sample_path, model, count(*) AS attempts, count(DISTINCT raw_preview) = 1 AS stable, CASE WHEN min(task) = max(task) THEN min(task) ELSE 'mixed' END AS task FROM att WHERE sample_path IS NOT NULL GROUP BY sample_path, model")
def stable_outputs(spark: SparkSession, root: str) -> DataFrame:
    """Whether repeated attempts on a sample gave one and the same answer."""
    rows = attempts(spark, root).filter(F.col("sample_path").isNotNull())
    one = F.min("raw_preview") == F.max("raw_preview")
    return rows.groupBy("sample_path", "model").agg(F.count("*").alias("attempts"), F.coalesce(one, F.lit(False)).alias("stable"), B.common_or_mixed(F.col("task")).alias("task"))


@query(
    "warnings",
    _ATT
    + """, s AS (SELECT model, count(*) AS n, avg(schema_success::INT) AS rate, avg(latency_ms) AS ms, count(latency_ms) AS timed FROM att GROUP BY model)
SELECT model, list_filter([CASE WHEN rate < 0.9 THEN 'schema_unstable' END, CASE WHEN ms > 2000 THEN 'slow' END, CASE WHEN timed < n THEN 'missing_latency' END, CASE WHEN n < 100 THEN 'few_attempts' END], lambda x: x IS NOT NULL)::VARCHAR AS warnings FROM s""",
)
def warnings(spark: SparkSession, root: str) -> DataFrame:
    """Warnings that hold for a model, in fixed order."""
    s = attempts(spark, root).groupBy("model").agg(F.count("*").alias("n"), F.avg(F.col("schema_success").cast("double")).alias("rate"), F.avg("latency_ms").alias("ms"), F.count("latency_ms").alias("timed"))
    found = F.array_compact(F.array(F.when(F.col("rate") < 0.9, "schema_unstable"), F.when(F.col("ms") > 2000, "slow"), F.when(F.col("timed") < F.col("n"), "missing_latency"), F.when(F.col("n") < 100, "few_attempts")))
    return s.select("model", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("warnings"))


@query(
    "model_order",
    _ATT
    + f", s AS (SELECT model, {r('avg(schema_success::INT)')} AS rate, {r('avg(quality.average)', 2)} AS quality, {r('avg(latency_ms)', 2)} AS ms FROM att WHERE model IS NOT NULL GROUP BY model) SELECT model, row_number() OVER (ORDER BY rate < 0.5, rate DESC, quality DESC NULLS LAST, ms ASC NULLS LAST, model) AS place FROM s",
)
def model_order(spark: SparkSession, root: str) -> DataFrame:
    """Models in the order of recommendation: unstable ones last, then by rate, quality and speed."""
    s = attempts(spark, root).filter(F.col("model").isNotNull()).groupBy("model").agg(
        half_up(F.avg(F.col("schema_success").cast("double")), 4).alias("rate"), half_up(F.avg("quality.average")).alias("quality"), half_up(F.avg("latency_ms")).alias("ms")
    )
    # one row per model
    order = Window.orderBy(F.col("rate") < 0.5, F.desc("rate"), F.desc_nulls_last("quality"), F.asc_nulls_last("ms"), "model")
    return s.select("model", F.row_number().over(order).alias("place"))


# --- reviewed collections -----------------------------------------------------------------


@query(
    "reject_recall",
    CUR
    + f", x AS (SELECT decision = 'reject' AS truth, total_score < 5.5 AS pred FROM cur WHERE decision IS NOT NULL AND total_score IS NOT NULL) SELECT count(*) FILTER (WHERE truth AND pred) AS hits, count(*) FILTER (WHERE truth) AS total, {r('count(*) FILTER (WHERE truth AND pred) / nullif(count(*) FILTER (WHERE truth), 0)::DOUBLE', 6)} AS recall, count(*) FILTER (WHERE truth AND NOT pred) AS missed, count(*) FILTER (WHERE NOT truth AND pred) AS false_alarms FROM x",
)
def reject_recall(spark: SparkSession, root: str) -> DataFrame:
    """Recall of rejects by a score threshold."""
    rows = current(spark, root, "decision").filter(F.col("decision").isNotNull() & F.col("total_score").isNotNull())
    truth, pred = F.col("decision") == "reject", F.col("total_score") < 5.5
    hits, total = F.count_if(truth & pred), F.count_if(truth)
    return rows.agg(hits.alias("hits"), total.alias("total"), half_up(B.share(hits, total), 6).alias("recall"), F.count_if(truth & ~pred).alias("missed"), F.count_if(~truth & pred).alias("false_alarms"))


@query(
    "scene_accuracy",
    CUR + f"SELECT count(*) AS photos, {r('avg((scene = scene_key)::INT)', 6)} AS accuracy, {r('''avg((scene_key = 'other')::INT)''', 6)} AS other_rate FROM cur WHERE scene IS NOT NULL",
)
def scene_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """Share of scenes that need no normalisation, and of the scene ``other``."""
    rows = current(spark, root).filter(F.col("scene").isNotNull())
    return rows.agg(F.count("*").alias("photos"), half_up(F.avg((F.col("scene") == F.col("scene_key")).cast("double")), 6).alias("accuracy"), half_up(F.avg((F.col("scene_key") == "other").cast("double")), 6).alias("other_rate"))


@query("score_separation", CUR + f"SELECT scene_key, {r('''min(CASE WHEN decision = 'keep' THEN total_score END) - max(CASE WHEN decision = 'reject' THEN total_score END)''')} AS separation FROM cur GROUP BY scene_key")
def score_separation(spark: SparkSession, root: str) -> DataFrame:
    """Lowest kept minus highest rejected score of each scene."""
    d, t = F.col("decision"), F.col("total_score")
    return current(spark, root, "decision").groupBy("scene_key").agg(half_up(F.min(F.when(d == "keep", t)) - F.max(F.when(d == "reject", t)), 4).alias("separation"))


@query(
    "face_metrics",
    CUR + f"SELECT scene_key, count(*) AS photos, CASE WHEN count(score_subject) = count(*) THEN {r('avg((score_subject >= 5)::INT)', 6)} END AS rate FROM cur GROUP BY scene_key",
)
def face_metrics(spark: SparkSession, root: str) -> DataFrame:
    """A rate that is only given where every photo of the scene has the prediction."""
    rate = half_up(F.avg((F.col("score_subject") >= 5).cast("double")), 6)
    return current(spark, root, "score_subject").groupBy("scene_key").agg(F.count("*").alias("photos"), F.when(F.count("score_subject") == F.count("*"), rate).alias("rate"))


@query(
    "pairwise_preference",
    CUR
    + """, s AS (SELECT file_path, group_key, total_score, group_rank FROM cur WHERE total_score IS NOT NULL AND group_rank IN (1, 2)),
p AS (SELECT a.total_score > b.total_score AS good FROM s a JOIN s b ON a.group_key = b.group_key AND a.group_rank = 1 AND b.group_rank = 2) SELECT count(*) AS pairs, count(*) FILTER (WHERE good) AS right_order FROM p""",
)
def pairwise_preference(spark: SparkSession, root: str) -> DataFrame:
    """Stored preferences (rank 1 over rank 2 of a group) that the scores agree with."""
    rows = current(spark, root, "group_rank").filter(F.col("total_score").isNotNull() & F.col("group_rank").isin(1, 2))
    best = rows.filter("group_rank = 1").select("group_key", F.col("total_score").alias("a"))
    next_best = rows.filter("group_rank = 2").select("group_key", F.col("total_score").alias("b"))
    return best.join(next_best, "group_key").agg(F.count("*").alias("pairs"), F.count_if(F.col("a") > F.col("b")).alias("right_order"))


@query(
    "preferred_is_best",
    CUR
    + """, b AS (SELECT group_key, arg_max(file_path, (total_score, file_path)) AS best FROM cur WHERE total_score IS NOT NULL GROUP BY group_key), p AS (SELECT group_key, min(file_path) AS preferred FROM cur WHERE group_rank = 1 GROUP BY group_key)
SELECT count(*) AS groups, count(*) FILTER (WHERE best = preferred) AS agreed FROM b JOIN p USING (group_key)""",
)
def preferred_is_best(spark: SparkSession, root: str) -> DataFrame:
    """Groups whose stored preference is the best by score, in one aggregation."""
    rows = current(spark, root, "group_rank")
    groups = rows.groupBy("group_key").agg(
        F.max_by(F.when(F.col("total_score").isNotNull(), F.col("file_path")), F.when(F.col("total_score").isNotNull(), F.struct("total_score", "file_path"))).alias("best"), F.min(F.when(F.col("group_rank") == 1, F.col("file_path"))).alias("preferred")
    )
    groups = groups.filter(F.col("best").isNotNull() & F.col("preferred").isNotNull())
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("best") == F.col("preferred")).alias("agreed"))


@query(
    "quality_roles",
    CUR
    + f""", m AS (SELECT file_path, 'technical' AS role, score_exposure AS v, 0.0 AS lo, 10.0 AS hi, false AS low, 2.0 AS w FROM cur UNION ALL SELECT file_path, 'technical', laplacian_variance, 0, 1500, false, 1 FROM cur
  UNION ALL SELECT file_path, 'technical', underexpose_ratio, 0, 0.5, true, 1 FROM cur UNION ALL SELECT file_path, 'aesthetic', score_composition, 0, 10, false, 1 FROM cur UNION ALL SELECT file_path, 'aesthetic', score_mood, 0, 10, false, 3 FROM cur),
n AS (SELECT file_path, role, w::DOUBLE AS w, 10 * (CASE WHEN low THEN 1 - greatest(0, least(1, (v - lo::DOUBLE) / (hi - lo)::DOUBLE)) ELSE greatest(0, least(1, (v - lo::DOUBLE) / (hi - lo)::DOUBLE)) END) AS s FROM m WHERE v IS NOT NULL AND isfinite(v))
SELECT file_path, role, {r('sum(s * w) / sum(w)')} AS score FROM n GROUP BY file_path, role""",
)
def quality_roles(spark: SparkSession, root: str) -> DataFrame:
    """Normalised quality metrics as a weighted mean per role of every photo."""
    rows = current(spark, root, "score_exposure", "laplacian_variance", "underexpose_ratio", "score_composition", "score_mood")
    spec = [("technical", "score_exposure", 0, 10, False, 2), ("technical", "laplacian_variance", 0, 1500, False, 1), ("technical", "underexpose_ratio", 0, 0.5, True, 1), ("aesthetic", "score_composition", 0, 10, False, 1), ("aesthetic", "score_mood", 0, 10, False, 3)]
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    # a weighted mean per role stays within the row: no unpivot and no shuffle
    out = []
    for role in ("technical", "aesthetic"):
        num, den = F.lit(0.0), F.lit(0.0)
        for _, c, low, high, lower, w in (s for s in spec if s[0] == role):
            v = finite(c)
            num = num + F.coalesce(quality_metric(v, low, high, F.lit(lower)) * w, F.lit(0.0))
            den = den + F.when(v.isNotNull(), float(w)).otherwise(0.0)
        out.append(F.when(den > 0, F.struct(F.lit(role).alias("role"), half_up(num / den, 4).alias("score"))))
    return rows.select("file_path", F.explode(F.array_compact(F.array(*out))).alias("x")).select("file_path", "x.*")


# --- vectors ------------------------------------------------------------------------------


@query(
    "embedding_top1",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id, a.label, b.vec_id AS n, b.label AS nl, floor(list_cosine_similarity(a.v, b.v) * 1e9 + 0.5) / 1e9 AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, n) AS k FROM p) SELECT vec_id, label::VARCHAR AS label, n AS neighbour, nl::VARCHAR AS neighbour_label FROM k WHERE k = 1""",
)
def embedding_top1(spark: SparkSession, root: str) -> DataFrame:
    """The nearest other vector of every vector and its label, exactly, in blocks."""
    rows = B.nearest_in_blocks(table(spark, root, "embeddings"), "vec_id", "embedding", "label")
    return rows.select("vec_id", "label", "neighbour", F.col("neighbour_group").alias("neighbour_label"))


@query(
    "same_label_top1",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id, a.label, b.vec_id AS n, b.label AS nl, floor(list_cosine_similarity(a.v, b.v) * 1e9 + 0.5) / 1e9 AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, n) AS k FROM p) SELECT label::VARCHAR AS label, count(*) AS items, count(*) FILTER (WHERE label = nl) AS same FROM k WHERE k = 1 GROUP BY label""",
)
def same_label_top1(spark: SparkSession, root: str) -> DataFrame:
    """How often the nearest vector has the same label."""
    rows = B.nearest_in_blocks(table(spark, root, "embeddings"), "vec_id", "embedding", "label")
    return rows.groupBy("label").agg(F.count("*").alias("items"), F.count_if(F.col("label") == F.col("neighbour_group")).alias("same"))


@query(
    "label_centroids",
    f"""WITH u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL),
v AS (SELECT label, list(m ORDER BY i) AS v FROM c GROUP BY label) SELECT a.label AS label_a, b.label AS label_b, {r('list_cosine_similarity(a.v, b.v)')} AS similarity FROM v a JOIN v b ON a.label < b.label""",
)
def label_centroids(spark: SparkSession, root: str) -> DataFrame:
    """Cosine similarity of the mean vectors of labels: a few rows after the aggregation."""
    rows = table(spark, root, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("v"))
    a, b = means.select(F.col("label").alias("label_a"), F.col("v").alias("va")), means.select(F.col("label").alias("label_b"), F.col("v").alias("vb"))
    return a.join(b, F.col("label_a") < F.col("label_b")).select("label_a", "label_b", half_up(cosine(F.col("va"), F.col("vb")), 4).alias("similarity"))


@query(
    "vector_functions",
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
x AS (SELECT vec_id, v, n, list_transform(v, lambda y: exp(y - list_max(v))) AS ex FROM e)
SELECT vec_id, {r('n')} AS norm, {r('CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END', 5)} AS first_unit, {r('CASE WHEN n > 0 THEN v[-1] / n ELSE v[-1] END', 5)} AS last_unit, {r('ex[1] / list_sum(ex)', 6)} AS first_probability, {r('list_max(ex) / list_sum(ex)', 6)} AS top_probability FROM x""",
)
def vector_functions(spark: SparkSession, root: str) -> DataFrame:
    """Length, unit form and softmax of vectors, within the row."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return table(spark, root, "embeddings").select("vec_id", half_up(norm, 4).alias("norm"), half_up(unit_vector(v)[0], 5).alias("first_unit"), half_up(F.element_at(unit_vector(v), -1), 5).alias("last_unit"), half_up(softmax(v)[0], 6).alias("first_probability"), half_up(F.array_max(softmax(v)), 6).alias("top_probability"))


# --- grids and sets -----------------------------------------------------------------------


@query(
    "param_grid",
    "SELECT * FROM (VALUES ('json_object'), ('json_schema')) a(mode), (VALUES ('base'), ('strict'), ('short')) b(preset), (VALUES (0.0::DOUBLE), (0.2), (0.4)) c(temperature), (VALUES (512::BIGINT), (1024), (1536)) d(edge)",
)
def param_grid(spark: SparkSession, root: str) -> DataFrame:
    """All combinations of stated parameter values."""
    return B.parameter_grid(spark, {"mode": ["json_object", "json_schema"], "preset": ["base", "strict", "short"], "temperature": [0.0, 0.2, 0.4], "edge": [512, 1024, 1536]})


@query(
    "model_sets",
    _ATT + """, s AS (SELECT run_id, list_sort(list(DISTINCT model)) AS m FROM att WHERE model IS NOT NULL GROUP BY run_id) SELECT m::VARCHAR AS models, count(*) AS runs FROM s GROUP BY m""",
)
def model_sets(spark: SparkSession, root: str) -> DataFrame:
    """Runs by the set of their models."""
    sets = attempts(spark, root).filter(F.col("model").isNotNull()).groupBy("run_id").agg(F.array_sort(F.collect_set("model")).alias("m"))
    return sets.groupBy("m").agg(F.count("*").alias("runs")).select(F.concat(F.lit("["), F.array_join("m", ", "), F.lit("]")).alias("models"), "runs")


@query(
    "reason_sets",
    """SELECT DISTINCT file_path, len(list_distinct(decision_reasons))::INT AS reasons, list_has_any(decision_reasons, ['soft focus', 'tilted horizon']) AS technical, len(list_filter(['soft focus', 'busy edges'], lambda x: NOT list_contains(decision_reasons, x)))::INT AS missing FROM processed WHERE decision_reasons IS NOT NULL""",
)
def reason_sets(spark: SparkSession, root: str) -> DataFrame:
    """Set operations on the reasons of a decision: distinct, overlap, difference."""
    rows = table(spark, root, "processed", ["file_path", "decision_reasons"]).filter(F.col("decision_reasons").isNotNull())
    reasons = F.col("decision_reasons")
    return rows.select(
        "file_path",
        F.size(F.array_distinct(reasons)).alias("reasons"),
        F.arrays_overlap(reasons, F.array(F.lit("soft focus"), F.lit("tilted horizon"))).alias("technical"),
        F.size(F.array_except(F.array(F.lit("soft focus"), F.lit("busy edges")), reasons)).alias("missing"),
    ).distinct()


@query(
    "label_separation",
    f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.label, {r('max(list_cosine_similarity(a.v, b.v))')} AS nearest_other FROM e a JOIN e b ON a.label <> b.label GROUP BY a.label""",
)
def label_separation(spark: SparkSession, root: str) -> DataFrame:
    """The greatest similarity of any vector of a label to one of another label, in blocks."""
    rows = B.nearest_in_blocks(table(spark, root, "embeddings"), "vec_id", "embedding", "label", other_groups=True)
    return rows.groupBy(F.col("label").cast("int").alias("label")).agg(half_up(F.max("cos"), 4).alias("nearest_other"))


@query("fastest_profile", _ATT + f", m AS (SELECT task, candidate.image_max_edge AS edge, {r('median(latency_ms)', 2)} AS ms FROM att WHERE latency_ms IS NOT NULL GROUP BY ALL) SELECT task, arg_min(edge, (ms, edge)) AS edge, min(ms) AS median_ms FROM m GROUP BY task")
def fastest_profile(spark: SparkSession, root: str) -> DataFrame:
    """The image size with the lowest median latency per task."""
    rows = attempts(spark, root).filter(F.col("latency_ms").isNotNull()).groupBy("task", F.col("candidate.image_max_edge").alias("edge")).agg(half_up(F.median("latency_ms")).alias("ms"))
    return rows.groupBy("task").agg(F.min_by("edge", F.struct("ms", "edge")).alias("edge"), F.min("ms").alias("median_ms"))


@query(
    "label_ranking",
    f"""WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT vec_id, i, x, max(x) OVER (PARTITION BY vec_id) AS top FROM u WHERE i < 8),
p AS (SELECT vec_id, i, exp(x - top) / sum(exp(x - top)) OVER (PARTITION BY vec_id) AS p FROM m) SELECT vec_id, 'label_' || i AS best, {r('p', 6)} AS probability FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS k FROM p) WHERE k = 1""",
)
def label_ranking(spark: SparkSession, root: str) -> DataFrame:
    """The most probable of eight labels by the softmax of their similarities."""
    from lumarank.functions.scoring import ranked_labels

    names = F.array(*[F.lit(f"label_{i}") for i in range(8)])
    rows = table(spark, root, "embeddings").select("vec_id", ranked_labels(names, F.slice(F.col("embedding").cast("array<double>"), 1, 8))[0].alias("x"))
    return rows.select("vec_id", F.col("x.label").alias("best"), half_up(F.col("x.p"), 6).alias("probability"))
