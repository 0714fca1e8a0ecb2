"""Text, commentary and parsing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumarank.constants import ABBREVIATIONS, ALL_DIMS, DIM_LABELS_EN, VISION_DIMS
from lumarank.functions import json_text as J
from lumarank.functions import text as X
from lumarank.operators import commentary as C
from lumarank.operators import ranking as R
from lumarank.plans.catalog import query
from lumarank.plans.common import CUR, current
from lumarank.plans.common import rs as r
from lumarank.runtime import table
from lumarank.runtime import reported as half_up

SCORES = [f"score_{d}" for d in ALL_DIMS]
_ONE = lambda x: f"printf('%.1f', floor(({x}) * 10 + 0.5) / 10)"


def documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents", ["doc_id", "text"])


@query("score_lines", CUR + "SELECT file_path, concat_ws(' ', " + ", ".join(f"'{ABBREVIATIONS[d]}:' || {_ONE('score_' + d)}" for d in ALL_DIMS) + ") AS line FROM cur")
def score_lines(spark: SparkSession, root: str) -> DataFrame:
    """One line with the known scores of every photo."""
    return current(spark, root, *SCORES).select("file_path", X.score_line({d: F.col(f"score_{d}") for d in ALL_DIMS}).alias("line"))


@query(
    "subject_tags",
    CUR
    + f"""SELECT file_path, '[' || array_to_string(l, ', ') || ']' AS tags FROM (SELECT file_path, list_filter(['pj:score=' || {_ONE('total_score')}, 'pj:rank=' || concat_ws('/', group_rank::VARCHAR, group_size::VARCHAR), 'pj:group=' || group_key, CASE WHEN coalesce(decision, '') <> '' THEN 'pj:decision=' || decision END,
  CASE WHEN group_boosted THEN 'pj:boosted' END], lambda x: x IS NOT NULL) AS l FROM cur)""",
)
def subject_tags(spark: SparkSession, root: str) -> DataFrame:
    """Machine tags of every photo."""
    rows = current(spark, root, "group_rank", "group_size", "decision", "group_boosted")
    tags = X.subject_tags(F.col("total_score"), F.col("group_rank"), F.col("group_size"), F.col("group_key"), F.col("decision"), F.col("group_boosted"))
    return rows.select("file_path", F.concat(F.lit("["), F.array_join(tags, ", "), F.lit("]")).alias("tags"))


@query(
    "language_mismatch",
    r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^ +| +$', '', 'g') AS b FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, b, length(regexp_replace(b, '[^\x{4e00}-\x{9fff}]', '', 'g')) AS han FROM t) SELECT doc_id, han AS cjk_chars FROM c""",
)
def cjk_chars(spark: SparkSession, root: str) -> DataFrame:
    """CJK characters of every document."""
    rows = documents(spark, root).filter(F.col("text").isNotNull())
    return rows.select("doc_id", X.cjk_count(F.trim("text")).cast("bigint").alias("cjk_chars"))


@query("wrong_language")
def wrong_language(spark: SparkSession, root: str) -> DataFrame:
    """Documents that are plainly not Chinese (word borders follow Unicode, which the SQL engine's patterns don't)."""
    return documents(spark, root).filter(X.language_mismatch(F.col("text"), "zh")).select("doc_id")


_HAS = lambda ws, t="t": "(" + " OR ".join(f"contains({t}, '{w}')" for w in ws) + ")"


@query(
    "post_quality",
    r"WITH p AS (SELECT DISTINCT json_extract_string(raw_preview, '$.post') AS post FROM attempts WHERE json_valid(raw_preview) AND json_type(raw_preview) = 'OBJECT'), q AS (SELECT post, trim(post) AS t FROM p WHERE post IS NOT NULL), h AS (SELECT *, length(regexp_replace(t, '[^\x{4e00}-\x{9fff}]', '', 'g')) AS han, "
    + " + ".join(f"contains(t, '{w}')::INT" for w in X.SPECIFIC)
    + r" AS hits, len(list_filter(regexp_split_to_array(regexp_replace(t, '([。！？])', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS sentences FROM q), "
    + f"f AS (SELECT post, (t <> '' AND lower(t) NOT IN ({', '.join(repr(w) for w in X.PLACEHOLDERS)}) AND han >= 4)::INT AS format_valid, {_HAS(X.ACTIONABLE)}::INT AS actionable, (hits >= 2 OR (length(t) >= 14 AND hits >= 1))::INT AS specificity, {_HAS(X.RELEVANT)}::INT AS photo_relevance, "
    + "(regexp_matches(t, '[。！？]$') AND sentences BETWEEN 1 AND 3 AND han >= greatest(4, length(t) // 5))::INT AS language_quality FROM h) SELECT *, format_valid + actionable + specificity + photo_relevance + language_quality AS average FROM f",
)
def post_quality(spark: SparkSession, root: str) -> DataFrame:
    """Five features of every distinct post hint that models gave."""
    posts = table(spark, root, "attempts", ["raw_preview"]).select(J.path_value(F.col("raw_preview"), "$.post").alias("post"), F.json_object_keys("raw_preview").alias("k"))
    posts = posts.filter(F.col("post").isNotNull() & F.col("k").isNotNull()).select("post").distinct()
    names = ("format_valid", "actionable", "specificity", "photo_relevance", "language_quality", "average")
    return posts.select("post", X.post_quality(F.col("post")).alias("q")).select("post", *[F.col(f"q.{n}").cast("int").alias(n) for n in names])


@query("top_texts", "SELECT trim(text) AS text, count(*) AS copies FROM documents WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY copies DESC, text LIMIT 5")
def top_texts(spark: SparkSession, root: str) -> DataFrame:
    """The five most repeated texts."""
    rows = documents(spark, root).select(F.trim("text").alias("text")).filter(F.col("text") != "").groupBy("text").agg(F.count("*").alias("copies"))
    return rows.filter(F.col("copies") > 1).orderBy(F.desc("copies"), "text").limit(5)


@query(
    "text_shapes",
    r"""SELECT doc_id, length(text) - length(replace(text, '=', '')) >= 3 AS raw_dump, regexp_replace(regexp_replace(lower(source), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  replace(replace(replace(replace(replace(source, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM documents""",
)
def text_shapes(spark: SparkSession, root: str) -> DataFrame:
    """Dump test of the whole text; slug and XML form of the source."""
    rows = table(spark, root, "documents", ["doc_id", "text", "source"])
    return rows.select("doc_id", X.raw_dump(F.col("text")).alias("raw_dump"), X.slug(F.col("source")).alias("slug"), X.xml_escape(F.col("source")).alias("escaped"))


@query(
    "commentary_sections",
    CUR
    + """, t AS (SELECT file_path, '【组内问题】' || coalesce(commentary_group_issues, '') || coalesce(' 【拍摄建议】' || commentary_shooting, '') AS t FROM cur),
p AS (SELECT *, instr(t, '【拍摄建议】') AS pos FROM t), s AS (SELECT file_path, CASE WHEN pos > 0 THEN trim(substr(t, 1, pos - 1)) ELSE t END AS issues, CASE WHEN pos > 0 THEN '【拍摄建议】' || trim(substr(t, pos + 6)) ELSE '' END AS shooting FROM p)
SELECT file_path, issues, shooting, CASE WHEN starts_with(trim(issues), '【组内问题】') THEN trim(substr(trim(issues), 7)) ELSE trim(issues) END AS body FROM s""",
)
def commentary_sections(spark: SparkSession, root: str) -> DataFrame:
    """A group commentary split into its sections, and the first without its prefix."""
    rows = current(spark, root, "commentary_group_issues", "commentary_shooting")
    whole = F.concat(F.lit(X.ISSUES_PREFIX["zh"]), F.coalesce("commentary_group_issues", F.lit("")), F.coalesce(F.concat(F.lit(" " + X.SHOOTING_PREFIX["zh"]), "commentary_shooting"), F.lit("")))
    rows = rows.withColumn("whole", whole).select("file_path", X.commentary_sections(F.col("whole")).alias("s")).select("file_path", "s.*")
    return rows.select("file_path", "issues", "shooting", X.without_prefix(F.col("issues"), X.ISSUES_PREFIX["zh"]).alias("body"))


@query("rank_sentences", CUR + "SELECT file_path, printf('Group ranking: this photo ranks #%d out of %d photos in the group.', group_rank, group_size) AS sentence FROM cur WHERE group_rank IS NOT NULL AND group_size IS NOT NULL")
def rank_sentences(spark: SparkSession, root: str) -> DataFrame:
    """The sentence on a photo's place in its group."""
    rows = current(spark, root, "group_rank", "group_size").filter(F.col("group_rank").isNotNull() & F.col("group_size").isNotNull())
    return rows.select("file_path", X.rank_sentence(F.col("group_rank"), F.col("group_size"), "en").alias("sentence"))


@query(
    "dominant_scenes",
    CUR
    + """, c AS (SELECT group_key, trim(scene) AS value, count(*) AS n, min(file_path) AS f FROM cur WHERE trim(scene) <> '' GROUP BY ALL)
SELECT group_key, value, n, k FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY n DESC, f) AS k FROM c) WHERE k <= 2""",
)
def dominant_scenes(spark: SparkSession, root: str) -> DataFrame:
    """The two most frequent scenes of every group."""
    return C.dominant(current(spark, root), ["group_key"], "scene", "file_path", 2)


@query(
    "group_prompts",
    CUR
    + f""", l AS (SELECT group_key, file_path, row_number() OVER (PARTITION BY group_key ORDER BY file_path) - 1 AS pos, file_path || ' ' || concat_ws(' ', {", ".join(f"'{ABBREVIATIONS[d]}:' || {_ONE('score_' + d)}" for d in VISION_DIMS)}) AS line FROM cur)
SELECT group_key, (pos // 50)::INT AS part, count(*) AS lines, string_agg(line, chr(10) ORDER BY pos) AS prompt FROM l GROUP BY ALL""",
)
def group_prompts(spark: SparkSession, root: str) -> DataFrame:
    """Prompts with one line per photo of a group, at most fifty lines each."""
    line = F.concat_ws(" ", "file_path", X.score_line({d: F.col(f"score_{d}") for d in VISION_DIMS}, order=VISION_DIMS))
    return C.group_prompt(current(spark, root, *SCORES), ["group_key"], "file_path", line)


@query(
    "weak_dim_names",
    CUR
    + f""", w AS (SELECT file_path, list_transform(list_sort(list_filter([{", ".join(f"{{'v': score_{d}, 'i': {i}, 'n': '{DIM_LABELS_EN[d]}'}}" for i, d in enumerate(VISION_DIMS))}], lambda x: x.v IS NOT NULL))[1:3], lambda x: x.n) AS d FROM cur)
SELECT file_path, CASE len(d) WHEN 0 THEN 'overall quality' WHEN 1 THEN d[1] WHEN 2 THEN d[1] || ' and ' || d[2] ELSE d[1] || ', ' || d[2] || ', and ' || d[3] END AS names FROM w""",
)
def weak_dim_names(spark: SparkSession, root: str) -> DataFrame:
    """The three weakest dimensions of a photo in prose."""
    rows = current(spark, root, *SCORES).select("file_path", R.lowest_values({d: F.col(f"score_{d}") for d in VISION_DIMS}, 3).alias("d"))
    return rows.select("file_path", C.dim_names(F.col("d"), "en").alias("names"))


@query("variant_picks", """WITH RECURSIVE k AS (SELECT p_partkey, p_name AS t FROM part),
f AS (SELECT p_partkey, t, 1 AS i, 1::BIGINT AS a, 0::BIGINT AS b FROM k UNION ALL SELECT p_partkey, t, i + 1, (a + ascii(substr(t, i, 1))) % 65521, (b + (a + ascii(substr(t, i, 1))) % 65521) % 65521 FROM f WHERE i <= length(t))
SELECT p_partkey, (b * 65536 + a) AS checksum, (['first', 'second', 'third'])[((b * 65536 + a) % 3)::INT + 1] AS pick FROM f WHERE i = length(t) + 1""")
def variant_picks(spark: SparkSession, root: str) -> DataFrame:
    """A wording chosen by the Adler-32 checksum of a name."""
    rows = table(spark, root, "part", ["p_partkey", "p_name"])
    return rows.select("p_partkey", X.adler32(F.col("p_name")).alias("checksum"), X.variant(["first", "second", "third"], F.col("p_name")).alias("pick"))


@query(
    "scene_contexts",
    CUR
    + f"""SELECT file_path, CASE WHEN {_HAS(X.STAGE_WORDS, "coalesce(scene_raw, '')")} THEN 'stage' WHEN {_HAS(X.CAMP_WORDS, "coalesce(scene_raw, '')")} THEN 'camp' WHEN scene = 'city' AND {_HAS(X.NIGHT_WORDS, "coalesce(scene_raw, '')")} THEN 'city_night'
  WHEN scene = 'detail' AND {_HAS(X.PRODUCT_WORDS, "coalesce(scene_raw, '')")} THEN 'product' WHEN coalesce(scene, '') = '' THEN 'default' ELSE scene END AS context FROM cur""",
)
def scene_contexts(spark: SparkSession, root: str) -> DataFrame:
    """Context of every photo from scene and free text."""
    return current(spark, root, "scene_raw").select("file_path", X.scene_context(F.col("scene"), F.col("scene_raw")).alias("context"))


# --- model answers ------------------------------------------------------------------------


@query("last_json_objects")
def last_json_objects(spark: SparkSession, root: str) -> DataFrame:
    """The last JSON object of every answer (a brace scan, which SQL has no form for)."""
    rows = table(spark, root, "attempts", ["attempt_id", "raw_preview"]).dropDuplicates(["attempt_id"])
    return rows.select("attempt_id", J.last_json_object("raw_preview").alias("object")).filter(F.col("object").isNotNull())


@query("vision_answers")
def vision_answers(spark: SparkSession, root: str) -> DataFrame:
    """Seven dimensions of every answer, of arrays, objects and prose."""
    rows = table(spark, root, "attempts", ["attempt_id", "raw_preview"]).dropDuplicates(["attempt_id"])
    return rows.select("attempt_id", J.vision_answer("raw_preview").alias("a")).select("attempt_id", "a.*")


@query("labelled_scores")
def labelled_scores(spark: SparkSession, root: str) -> DataFrame:
    """Scores read from free text."""
    return documents(spark, root).select("doc_id", J.labelled_score(F.col("text")).alias("score")).filter(F.col("score").isNotNull())


@query(
    "answer_contracts",
    """WITH a AS (SELECT DISTINCT attempt_id, raw_preview FROM attempts), j AS (SELECT attempt_id, CASE WHEN json_valid(raw_preview) AND json_type(raw_preview) = 'OBJECT' THEN list_sort(json_keys(raw_preview)) END AS k FROM a)
SELECT attempt_id, coalesce(k = ['post'], false) AS is_post, CASE WHEN k IS NOT NULL THEN len(list_filter(['color', 'composition', 'lighting'], lambda x: NOT list_contains(k, x)))::INT END AS missing FROM j""",
)
def answer_contracts(spark: SparkSession, root: str) -> DataFrame:
    """Key sets of JSON answers against their contracts."""
    rows = table(spark, root, "attempts", ["attempt_id", "raw_preview"]).distinct()
    text = F.col("raw_preview")
    missing = F.size(J.missing_keys(text, ("color", "composition", "lighting")))
    return rows.select("attempt_id", J.has_exactly(text, ("post",)).alias("is_post"), F.when(F.json_object_keys(text).isNotNull(), missing).alias("missing"))


@query("redacted_payloads")
def redacted_payloads(spark: SparkSession, root: str) -> DataFrame:
    """Payloads without vectors and secrets at any depth."""
    rows = table(spark, root, "processed", ["file_path", "score_metadata"]).distinct()
    return rows.select("file_path", J.without_secrets(J.without_vectors("score_metadata")).alias("payload")).filter(F.col("payload").isNotNull())
