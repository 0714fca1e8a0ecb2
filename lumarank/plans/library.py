"""Library browsing, scenes, repairs and incremental state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumarank.constants import LEGACY_SCENES, SCENE_KEYWORDS, SCENE_LABELS_EN, SCENE_LABELS_ZH, SCENES
from lumarank.functions import identity as I
from lumarank.functions import json_text as J
from lumarank.functions import text as X
from lumarank.operators import library as L
from lumarank.operators import ranking as R
from lumarank.plans.catalog import query
from lumarank.plans.common import CUR, current
from lumarank.plans.common import rs as r
from lumarank.runtime import latest, table
from lumarank.runtime import reported as half_up

_INDEX = """, idx AS (SELECT file_path, file_size, mtime_ns FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY mtime_ns DESC NULLS LAST, file_size DESC NULLS LAST) AS k FROM visual_hash_cache WHERE file_path IS NOT NULL) WHERE k = 1)"""


def index(spark: SparkSession, root: str) -> DataFrame:
    """Files of the library with their fingerprint."""
    rows = table(spark, root, "visual_hash_cache", ["file_path", "file_size", "mtime_ns"]).filter(F.col("file_path").isNotNull())
    return latest(rows, ["file_path"], [F.col("mtime_ns"), F.col("file_size")], ["file_size", "mtime_ns"])


def items(spark: SparkSession, root: str) -> DataFrame:
    scores = current(spark, root, "decision", "status").select("file_path", "total_score", "scene_key", "decision", "status")
    return L.with_scores(index(spark, root), scores)


@query("latest_scores", CUR + f"SELECT file_path, status, {r('total_score')} AS total_score, processed_at FROM cur")
def latest_scores(spark: SparkSession, root: str) -> DataFrame:
    """The latest row of every file."""
    return current(spark, root, "status").select("file_path", "status", half_up(F.col("total_score"), 4).alias("total_score"), "processed_at")


@query("library_summary", CUR + _INDEX + f"SELECT count(*) AS indexed, count(total_score) AS scored, count(status) AS records, count(*) FILTER (WHERE status = 'error') AS errors, {r('avg(total_score)', 3)} AS average_score FROM idx LEFT JOIN cur USING (file_path)")
def library_summary(spark: SparkSession, root: str) -> DataFrame:
    """Counts and mean score of the indexed library."""
    return L.summary(items(spark, root)).withColumn("average_score", half_up(F.col("average_score"), 3))


@query("library_scenes", CUR + _INDEX + "SELECT coalesce(scene_key, 'unscored') AS scene, count(*) AS photos FROM idx LEFT JOIN cur USING (file_path) GROUP BY ALL ORDER BY photos DESC, scene LIMIT 20")
def library_scenes(spark: SparkSession, root: str) -> DataFrame:
    """The twenty most frequent scenes."""
    rows = items(spark, root).groupBy(F.coalesce("scene_key", F.lit("unscored")).alias("scene")).agg(F.count("*").alias("photos"))
    return rows.orderBy(F.desc("photos"), "scene").limit(20)


@query(
    "library_page",
    CUR + _INDEX + f"SELECT file_path, {r('total_score')} AS total_score, scene_key, decision FROM idx LEFT JOIN cur USING (file_path) WHERE contains(lower(file_path), 'img_') AND total_score IS NOT NULL ORDER BY cur.total_score DESC NULLS LAST, file_path LIMIT 48 OFFSET 48",
)
def library_page(spark: SparkSession, root: str) -> DataFrame:
    """The second page of scored files that match a search, best first."""
    found = L.matching(items(spark, root), search="IMG_", scored="yes")
    return R.page(found, L.order_of("score_desc"), 2, 48).select("file_path", half_up(F.col("total_score"), 4).alias("total_score"), "scene_key", "decision")


@query(
    "library_filter",
    CUR + _INDEX + "SELECT file_path FROM idx LEFT JOIN cur USING (file_path) WHERE contains(lower(file_path), '/travel/') AND coalesce(scene_key, '') = 'landscape' AND coalesce(decision, '') = 'keep' ORDER BY idx.mtime_ns DESC NULLS LAST, file_path LIMIT 200",
)
def library_filter(spark: SparkSession, root: str) -> DataFrame:
    """The newest kept landscapes below a folder."""
    found = L.matching(items(spark, root), search="/travel/", scene="landscape", decision="keep")
    return R.page(found, L.order_of("newest"), 1, 200).select("file_path")


@query("unscored_files", CUR + _INDEX + "SELECT idx.file_path FROM idx WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.file_path = idx.file_path)")
def unscored_files(spark: SparkSession, root: str) -> DataFrame:
    """Indexed files that were never scored: what an incremental run still has to do."""
    return index(spark, root).join(current(spark, root).select("file_path"), "file_path", "left_anti").select("file_path")


@query("stale_files", CUR + _INDEX + "SELECT cur.file_path FROM cur WHERE NOT EXISTS (SELECT 1 FROM idx WHERE cur.file_path = idx.file_path)")
def stale_files(spark: SparkSession, root: str) -> DataFrame:
    """Scored files that the latest index no longer holds."""
    return current(spark, root).select("file_path").join(index(spark, root), "file_path", "left_anti")


@query(
    "valid_results",
    CUR + _INDEX + "SELECT status, count(*) AS files, count(*) FILTER (WHERE (cur.file_size IS NOT DISTINCT FROM idx.file_size AND cur.mtime_ns IS NOT DISTINCT FROM idx.mtime_ns) OR cur.file_size IS NULL OR cur.mtime_ns IS NULL) AS valid FROM cur JOIN idx USING (file_path) GROUP BY ALL",
)
def valid_results(spark: SparkSession, root: str) -> DataFrame:
    """Stored results whose fingerprint still is that of the file, by status."""
    stored = current(spark, root, "status", "file_size", "mtime_ns").select("file_path", "status", F.col("file_size").alias("s"), F.col("mtime_ns").alias("m"))
    joined = stored.join(index(spark, root), "file_path")
    return joined.groupBy("status").agg(F.count("*").alias("files"), F.count_if(I.fingerprint_current(F.col("file_size"), F.col("mtime_ns"), F.col("s"), F.col("m"))).alias("valid"))


@query("cache_coverage", _INDEX.replace(", idx", "WITH idx", 1) + ", emb AS (SELECT DISTINCT file_path FROM embedding_cache) SELECT count(*) AS files, count(emb.file_path) AS cached FROM idx LEFT JOIN emb USING (file_path)")
def cache_coverage(spark: SparkSession, root: str) -> DataFrame:
    """How many indexed files have a cached vector of any model."""
    cached = table(spark, root, "embedding_cache", ["file_path"]).distinct().withColumn("hit", F.lit(1))
    return index(spark, root).join(cached, "file_path", "left").agg(F.count("*").alias("files"), F.count("hit").alias("cached"))


# --- scenes -------------------------------------------------------------------------------


@query("scene_distribution", CUR + "SELECT scene, scene_raw, count(*) AS photos FROM cur GROUP BY ALL")
def scene_distribution(spark: SparkSession, root: str) -> DataFrame:
    """Photos by scene and free scene text."""
    return current(spark, root, "scene_raw").groupBy("scene", "scene_raw").agg(F.count("*").alias("photos"))


@query(
    "scene_listing",
    CUR
    + """, c AS (SELECT coalesce(scene, 'other') AS scene, scene_raw, count(*) AS photos FROM cur WHERE scene_raw IS NOT NULL AND scene_raw <> '' GROUP BY ALL)
SELECT scene, scene_raw, photos, k FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY photos DESC, scene_raw) AS k FROM c) WHERE k <= 20""",
)
def scene_listing(spark: SparkSession, root: str) -> DataFrame:
    """The twenty most frequent free texts of every scene."""
    from pyspark.sql import Window

    rows = current(spark, root, "scene_raw").filter(F.coalesce("scene_raw", F.lit("")) != "").groupBy(F.coalesce("scene", F.lit("other")).alias("scene"), "scene_raw").agg(F.count("*").alias("photos"))
    k = F.row_number().over(Window.partitionBy("scene").orderBy(F.desc("photos"), "scene_raw"))
    return rows.withColumn("k", k).filter(F.col("k") <= 20)


_SUGGEST = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(raw, '{w}')''' for w in words)} THEN '{scene}'" for scene, words in SCENE_KEYWORDS.items()) + " END"


@query(
    "scene_suggestions",
    CUR + f", c AS (SELECT scene_raw AS raw, count(*) AS photos FROM cur WHERE scene_raw IS NOT NULL AND scene_raw <> '' GROUP BY ALL HAVING count(*) >= 2 ORDER BY photos DESC, raw LIMIT 50) SELECT raw, photos, {_SUGGEST} AS suggestion FROM c WHERE {_SUGGEST} IS NOT NULL",
)
def scene_suggestions(spark: SparkSession, root: str) -> DataFrame:
    """Frequent free texts that suggest a scene."""
    rows = current(spark, root, "scene_raw").filter(F.coalesce("scene_raw", F.lit("")) != "").select(F.col("scene_raw").alias("raw"))
    return L.suggestions(rows, X.suggested_scene(F.col("raw")), 2, 50)


_LEG = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEGACY_SCENES.items()) + " END"
_LABEL = lambda key, labels, other: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE '{other}' END"


@query(
    "scene_keys",
    "WITH t AS (SELECT DISTINCT coalesce(scene, scene_raw, '') AS raw FROM processed UNION SELECT * FROM (VALUES ('人物'), (' 城市 '), ('Wildlife'), ('FOOD'), ('nonsense')))"
    + f", u AS (SELECT raw, trim(raw) AS b, lower(trim(raw)) AS x FROM t) SELECT raw, coalesce(CASE b {' '.join(f'''WHEN '{v}' THEN '{k}' ''' for k, v in SCENE_LABELS_ZH.items())} {' '.join(f'''WHEN '{s}' THEN '{s}' ''' for s in SCENES)} END, {_LEG}) AS scene_key,"
    + f" x IN ({', '.join(repr(s) for s in sorted({*SCENES, *LEGACY_SCENES}))}) OR b IN ({', '.join(repr(s) for s in SCENE_LABELS_ZH.values())}) AS is_label, {_LABEL(f'coalesce(({_LEG.replace('CASE x', 'CASE raw')}), raw)', SCENE_LABELS_EN, 'Other')} AS label FROM u",
)
def scene_keys(spark: SparkSession, root: str) -> DataFrame:
    """Scene texts with their key, whether they are a label, and the label of their key."""
    rows = table(spark, root, "processed", ["scene", "scene_raw"]).select(F.coalesce("scene", "scene_raw", F.lit("")).alias("raw"))
    extra = spark.createDataFrame([(x,) for x in ("人物", " 城市 ", "Wildlife", "FOOD", "nonsense")], "raw string")
    raw = F.col("raw")
    return rows.unionByName(extra).distinct().select("raw", X.scene_key(raw).alias("scene_key"), X.is_scene_label(raw).alias("is_label"), X.scene_label(raw, "en").alias("label"))


_NAMES = ", ".join(repr(s) for s in sorted({*SCENES, *LEGACY_SCENES}))


@query(
    "repair_counts",
    CUR
    + f"SELECT count(*) FILTER (WHERE star_rating IS NULL AND total_score IS NOT NULL) AS stars_repaired, count(*) FILTER (WHERE group_rank IS NULL AND status = 'done') AS groups_repaired, count(*) FILTER (WHERE lower(trim(scene)) IN ({', '.join(repr(s) for s in LEGACY_SCENES)})) AS scenes_migrated, count(*) FILTER (WHERE lower(trim(scene_raw)) IN ({_NAMES}) OR trim(scene_raw) IN ({', '.join(repr(s) for s in SCENE_LABELS_ZH.values())})) AS texts_cleared FROM cur",
)
def repair_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many rows each repair of the stored state would change, in one pass."""
    rows = current(spark, root, "star_rating", "group_rank", "status", "scene_raw")
    return rows.agg(
        F.count_if(F.col("star_rating").isNull() & F.col("total_score").isNotNull()).alias("stars_repaired"),
        F.count_if(F.col("group_rank").isNull() & (F.col("status") == "done")).alias("groups_repaired"),
        F.count_if(F.lower(F.trim("scene")).isin(*LEGACY_SCENES)).alias("scenes_migrated"),
        F.count_if(X.is_scene_label(F.col("scene_raw"))).alias("texts_cleared"),
    )


@query(
    "repaired_rows",
    CUR + f"SELECT file_path, coalesce(star_rating, floor(total_score / 2 + 0.5)::INT) AS star_rating, CASE WHEN status = 'done' THEN coalesce(group_rank, 1) ELSE group_rank END AS group_rank, CASE WHEN lower(trim(scene_raw)) IN ({_NAMES}) OR trim(scene_raw) IN ({', '.join(repr(s) for s in SCENE_LABELS_ZH.values())}) THEN '' ELSE scene_raw END AS scene_raw FROM cur",
)
def repaired_rows(spark: SparkSession, root: str) -> DataFrame:
    """The state after the repairs."""
    rows = current(spark, root, "star_rating", "group_rank", "status", "scene_raw")
    stars = F.coalesce("star_rating", F.floor(F.col("total_score") / 2 + 0.5).cast("int"))
    rank = F.when(F.col("status") == "done", F.coalesce("group_rank", F.lit(1))).otherwise(F.col("group_rank"))
    raw = F.when(X.is_scene_label(F.col("scene_raw")), "").otherwise(F.col("scene_raw"))
    return rows.select("file_path", stars.alias("star_rating"), rank.alias("group_rank"), raw.alias("scene_raw"))


# --- payloads -----------------------------------------------------------------------------


@query(
    "metadata_fields",
    CUR
    + """SELECT file_path, CASE WHEN score_metadata_version = 1 AND coalesce(CASE WHEN json_valid(score_metadata) THEN json_type(score_metadata) = 'OBJECT' END, false) THEN json_extract_string(score_metadata, '$.meta.engine') END AS engine,
  CASE WHEN coalesce(CASE WHEN json_valid(score_metadata) THEN json_type(score_metadata) = 'OBJECT' END, false) THEN json_extract_string(score_metadata, '$.boosted') = 'true' END AS boosted, coalesce(CASE WHEN json_valid(score_metadata) THEN json_type(score_metadata) = 'OBJECT' END, false) AS readable,
  CASE WHEN coalesce(CASE WHEN json_valid(xmp_payload) THEN json_type(xmp_payload) = 'OBJECT' END, false) THEN json_extract_string(xmp_payload, '$.rating')::INT END AS rating FROM cur""",
)
def metadata_fields(spark: SparkSession, root: str) -> DataFrame:
    """Fields of versioned JSON payloads; broken ones give nulls."""
    rows = current(spark, root, "score_metadata", "score_metadata_version", "xmp_payload")
    meta, ok = F.col("score_metadata"), F.json_object_keys("score_metadata").isNotNull()
    return rows.select(
        "file_path",
        F.when(ok & (F.col("score_metadata_version") == 1), J.path_value(meta, "$.meta.engine")).alias("engine"),
        F.when(ok, J.path_value(meta, "$.boosted") == "true").alias("boosted"),
        ok.alias("readable"),
        F.when(F.json_object_keys("xmp_payload").isNotNull(), J.path_value(F.col("xmp_payload"), "$.rating").try_cast("int")).alias("rating"),
    )


@query("json_filter", "SELECT event_type, count(*) AS events, sum(json_extract_string(props, '$.k')::BIGINT) AS k_sum FROM events WHERE json_extract_string(props, '$.k')::BIGINT BETWEEN 20 AND 60 GROUP BY ALL")
def json_filter(spark: SparkSession, root: str) -> DataFrame:
    """Events by a value within their JSON."""
    k = J.path_value(F.col("props"), "$.k").cast("bigint")
    return table(spark, root, "events", ["event_type", "props"]).filter(k.between(20, 60)).groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("k_sum"))


@query("file_names", "SELECT DISTINCT file_path, substr(sha256(file_path), 1, 32) AS library_id, upper(regexp_extract(file_path, '[^/.]\\.([^./]+)$', 1)) AS extension, (('0x' || substr(sha256(file_path), 1, 8))::BIGINT % 100)::INT AS bucket FROM visual_hash_cache WHERE file_path IS NOT NULL")
def file_names(spark: SparkSession, root: str) -> DataFrame:
    """Identifier, extension and split bucket of every indexed file."""
    p = F.col("file_path")
    return table(spark, root, "visual_hash_cache", ["file_path"]).filter(p.isNotNull()).distinct().select(p, I.library_id(p).alias("library_id"), X.extension(p).alias("extension"), I.split_bucket(p).alias("bucket"))


@query("group_names", CUR + "SELECT group_key, 'group_' || substr(sha256(string_agg(file_path, chr(0) ORDER BY file_path)), 1, 16) AS group_id, count(*) AS members FROM cur GROUP BY ALL")
def group_names(spark: SparkSession, root: str) -> DataFrame:
    """Group identifiers from the sorted members."""
    from lumarank.operators.grouping import named_groups

    return named_groups(current(spark, root), ["group_key"], "file_path")


@query(
    "reset_counts",
    "SELECT 'processed' AS state, count(*) AS rows_before FROM processed UNION ALL SELECT 'embedding_cache', count(*) FROM embedding_cache UNION ALL SELECT 'visual_hash_cache', count(*) FROM visual_hash_cache",
)
def reset_counts(spark: SparkSession, root: str) -> DataFrame:
    """Row counts before a reset, the caches that stay included."""
    names = ("processed", "embedding_cache", "visual_hash_cache")
    parts = [table(spark, root, n).agg(F.count("*").alias("rows_before")).select(F.lit(n).alias("state"), "rows_before") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
