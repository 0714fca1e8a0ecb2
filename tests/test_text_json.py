import zlib

from pyspark.sql import functions as F

from lumarank.functions import identity as I
from lumarank.functions import json_text as J
from lumarank.functions import text as X


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def test_hashes(spark):
    keys = ["", "abc", "schöne Fotos", "夜市"]
    assert col(spark, keys, X.adler32(F.col("x"))) == [zlib.adler32(k.encode()) for k in keys]
    assert col(spark, ["abc", None], X.variant(["p", "q", "r"], F.col("x"))) == [["p", "q", "r"][zlib.adler32(b"abc") % 3], "p"]
    a = F.array(F.lit("b"), F.lit("a"))
    import hashlib

    assert col(spark, ["x"], I.group_id(a)) == ["group_" + hashlib.sha256(b"a\x00b").hexdigest()[:16]]
    assert col(spark, ["p"], I.split_bucket(F.col("x"))) == [int(hashlib.sha256(b"p").hexdigest()[:8], 16) % 100]
    assert col(spark, ["0000000000000000"], I.hamming(I.hash_value(F.col("x")), F.lit(-1).cast("bigint"))) == [64]
    assert I.config_key({"b": 1, "a": 2}) == I.config_key({"a": 2, "b": 1}) != I.config_key({"a": 2, "b": 2})


def test_scene_texts(spark):
    assert col(spark, ["人物", " sports ", "Food", "nope", None], X.scene_key(F.col("x"))) == ["people", "sports", "detail", None, None]
    assert col(spark, ["夜景里的狗", "山", "空"], X.suggested_scene(F.col("x"))) == ["animals", "landscape", None]
    assert col(spark, ["concert", "x"], X.scene_label(F.col("x"), "en")) == ["People", "Other"]


def test_strings(spark):
    assert col(spark, ["100%_x", "100abx"], X.substring_search(F.col("x"), "%_")) == [True, False]
    assert col(spark, ["/a/b.Jpg", "/a/.hidden", "/a.b/c"], X.extension(F.col("x"))) == ["JPG", "", ""]
    assert col(spark, ["Ab C!!d-"], X.slug(F.col("x"))) == ["ab-c-d"]
    assert col(spark, ["<a & 'b'>"], X.xml_escape(F.col("x"))) == ["&lt;a &amp; &apos;b&apos;&gt;"]
    assert col(spark, ["plain english words only here", "你好世界 hello", "", None], X.language_mismatch(F.col("x"), "zh")) == [True, False, False, False]
    parts = col(spark, ["Group issues: a Shooting advice: b", "none"], X.commentary_sections(F.col("x"), "en"))
    assert tuple(parts[0]) == ("Group issues: a", "Shooting advice:b") and tuple(parts[1]) == ("none", "")
    assert col(spark, [59.0, 3661.0, None], X.eta_text(F.col("x")), "double") == ["0:59", "1:01:01", "--:--"]
    assert col(spark, [None], X.score_line({"subject": F.col("x").cast("double"), "mood": F.lit(7.25)})) == ["mood:7.3"]


def test_json(spark):
    texts = ['note {"a": 1} then {"b": <2>, "c": [1,],}', "no object", "", None, '{"a": {"vector": [1], "k": {"api_key": "s", "n": 1}}}']
    assert col(spark, texts, J.last_json_object(F.col("x")))[:4] == ['{"b":2,"c":[1]}', None, None, None]
    assert col(spark, texts, J.without_secrets(J.without_vectors(F.col("x"))))[4] == '{"a":{"k":{"api_key":"[REDACTED]","n":1}}}'
    assert col(spark, ['{"a":1,"b":2}', '{"a":1}', "bad"], J.has_exactly(F.col("x"), ("b", "a"))) == [True, False, False]
    assert col(spark, ["bad", "[1]", '{"a":1}'], J.json_object(F.col("x"))) == ["{}", "{}", '{"a":1}']


def test_scores_in_text(spark):
    texts = ['{"overall": 0.7}', "Score: 8.5 of it", "The rating is roughly 12", "overall on a scale of 1 to 10 is 4", "6", "nothing", "-3"]
    assert col(spark, texts, J.labelled_score(F.col("x"))) == [7.0, 8.5, 10.0, None, 6.0, None, 0.0]


def test_scores_told_in_sentences(spark):
    texts = ["I'd say the overall looks like 7/10.", "rating = .5", "Overall: n/a. score: 0.65", "the score, as far as I can tell, is maybe 6.5!", "score is high. " + "so " * 60 + "is 9", '{"score": true}', "`overall` : 9", "version 3", "-3.5", None]
    assert col(spark, texts, J.labelled_score(F.col("x"))) == [7.0, None, 6.5, 6.5, None, None, 9.0, None, 0.0, None]


def test_vision_answers():
    whole = J.parse_vision('{"subject": 8, "composition": 7, "lighting": 6, "color": 5, "clarity": 4, "depth": 3, "mood": 22, "scene": "City"}')
    assert whole["ok"] and whole["mood"] == 10.0 and whole["scene"] == "city"
    assert J.parse_vision("[1, 2, 3, 4, 5, 6, 7]")["depth"] == 6.0
    assert J.parse_vision("subject: 7.5, mood = 3")["subject"] == 7.5
    assert not J.parse_vision(None)["ok"] and J.parse_vision("junk")["scene"] == "other"
