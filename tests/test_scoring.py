import pytest
from pyspark.sql import functions as F

from lumarank.constants import AESTHETIC_DIMS
from lumarank.functions import scoring as S

WEIGHTS = dict(zip(AESTHETIC_DIMS, (0.25, 0.15, 0.20, 0.15, 0.10, 0.15)))


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def signals(spark, *rows):
    names = ["file_path", "technical_quality", "subject_focus", "screening_prior", *AESTHETIC_DIMS]
    return spark.createDataFrame([(*r, "x") for r in rows], ", ".join(f"{n} {'string' if n == 'file_path' else 'double'}" for n in names) + ", scene string")


def test_layered_summary_golden(spark, monkeypatch):
    monkeypatch.setattr(S, "AESTHETIC_WEIGHTS", {"default": WEIGHTS})
    rows = S.layered_summary(signals(spark, ("a", 8.8, 8.4, 7.6, 8.8, 8.0, 7.8, 7.6, 7.4, 8.1), ("b", 5.1, 4.8, 5.2, 5.0, 5.2, 4.9, 5.1, 4.7, 5.0))).orderBy("file_path").collect()
    a, b = rows
    assert (a.aesthetic, a.base, a.penalty, a.total, a.stars, a.decision) == (8.05, 8.25, 0.0, 8.25, 4, "keep")
    assert (b.aesthetic, b.base, b.penalty, b.total, b.stars, b.decision) == (5.0, 5.02, 0.60, 4.42, 2, "reject")


def test_summary_without_any_signal(spark):
    row = S.layered_summary(spark.createDataFrame([("a", None)], "file_path string, scene string")).first()
    assert (row.tech, row.aesthetic, row.total, row.decision) == (0.0, 0.0, 0.0, "reject")
    assert row.reasons == ["technical_quality_low", "subject_focus_low"]


def test_overall_aesthetic_owns_the_total(spark):
    df = spark.createDataFrame([(9.0, 9.0, 9.0, 7.0, 2.0, "people")], "technical_quality double, subject_focus double, screening_prior double, overall_aesthetic double, composition double, scene string")
    row = S.layered_summary(df).first()
    assert row.aesthetic == 7.0 and row.penalty == 0.0


def test_ramps(spark):
    x = F.col("x")
    assert one(spark, S.falling(x, 0.2, 0.4), x=0.2) == 10.0
    assert one(spark, S.falling(x, 0.2, 0.4), x=0.3) == pytest.approx(5.0)
    assert one(spark, S.centred(x, 0.5, 0.2), x=0.7) == pytest.approx(0.0, abs=1e-9)
    assert one(spark, S.rising(x, 50, 1000), x=525.0) == pytest.approx(5.0)
    assert one(spark, S.relative_focus(x, F.lit(0.0)), x=5.0) == 0.0
    assert S.scaled_thresholds(0.5, 0.7, 2.0, 1.0) == (0.999, 0.999)


def test_weighted_mean_with_floor(spark):
    arr = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert one(spark, S.weighted_mean(arr(8, 6), arr(3, 1)), x=0.0) == 7.5
    assert one(spark, S.weighted_mean(arr(8, 2), arr(3, 1), arr(0, 3)), x=0.0) == 3.0
    assert one(spark, S.weighted_mean(arr(8), arr(0)), x=0.0) is None


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.95), F.lit(0.05))
    assert one(spark, S.cosine(a, b), x=0.0) == pytest.approx(0.998617, abs=1e-6)
    assert one(spark, S.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), x=0.0) == 0.0
    assert one(spark, S.cosine(a, F.array(F.lit(1.0))), x=0.0) == 0.0
    assert one(spark, S.expected_grade(F.array(*[F.lit(1.0)] * 10)), x=0.0) == 5.5
    assert sum(one(spark, S.softmax(b), x=0.0)) == pytest.approx(1.0)
    with pytest.raises(Exception, match="empty distribution"):
        one(spark, S.expected_grade(F.array(F.lit(0.0))), x=0.0)


def test_calibration(spark):
    assert one(spark, S.calibrated(F.col("x"), F.lit(1.0), F.lit(2.0), blend=0.8), x=6.0) == pytest.approx(7.6)
    assert one(spark, S.calibrated(F.col("x"), F.lit(1.5), F.lit(2.0)), x=9.0) == 10.0


def test_boxes_and_objects(spark):
    df = spark.createDataFrame(
        [([("chair", 0.9, [0.0, 0.0, 0.2, 0.2]), ("person", 0.9, [0.3, 0.3, 0.7, 0.7])],)], "o array<struct<label:string,confidence:double,bbox:array<double>>>"
    )
    row = df.select(S.primary_object(F.col("o")).alias("p"), F.size(S.ranked_detections(F.col("o"), 0.95, 1)).alias("n")).first()
    assert row.p.label == "person" and row.n == 0
    empty = spark.createDataFrame([([],)], "o array<struct<label:string,confidence:double,bbox:array<double>>>")
    assert empty.select(S.primary_object(F.col("o")).alias("p")).first().p is None
    box = F.array(*[F.lit(v) for v in (0.5, 0.5, 0.9, 0.9)])
    assert one(spark, S.bbox_coverage(box, F.array(*[F.lit(v) for v in (0.0, 0.0, 0.7, 1.0)])), x=0.0) == pytest.approx(0.5)
    assert one(spark, S.bbox_clamped(box, 0.5), x=0.0) == pytest.approx([0.3, 0.3, 1.0, 1.0])


def test_first_rule_wins(spark):
    rules = [(F.col("x") < 1, "blur"), (F.col("x") < 5, "pixel")]
    assert [one(spark, S.first_true(rules, "full"), x=v) for v in (0.5, 3.0, 9.0)] == ["blur", "pixel", "full"]


def test_rounding_is_that_of_the_exact_value(spark):
    from lumarank.runtime import half_up

    values = [k / 1000 for k in range(-3000, 12000, 5)] + [0.125, 0.375, 2.5, 8.055, 4.995, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r.y for r in df.select("i", half_up(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [None if v is None else round(v, 2) for v in values]


def test_softmax_of_a_long_vector(spark):
    import math

    v = [i / 100 for i in range(400)]
    got = spark.createDataFrame([(v,), (None,), ([],)], "v array<double>").select(S.softmax(F.col("v")).alias("p")).collect()
    total = sum(math.exp(x - v[-1]) for x in v)
    assert all(abs(a - math.exp(x - v[-1]) / total) < 1e-12 for a, x in zip(got[0].p, v)) and got[1].p is None and got[2].p == []


def test_both_ways_of_rounding_agree(spark):
    from lumarank.runtime import half_up, rounded

    values = [2.675, 0.125, 0.375, 1.005, 5.0, 7.345, 9.995, 0.0, None, -1.005, 3.14159, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("a", half_up(F.col("v")))
    rows = rounded(df, {"b": F.col("v") + 0.0}).collect()
    assert [str(r.a) for r in rows] == [str(r.b) for r in rows]
    assert [r.b for r in rows][:8] == [round(v, 2) for v in values[:8]]


def test_stored_signals_take_the_place_of_legacy_ones(spark):
    from lumarank.plans.scores import SIGNALS, with_stored_signals

    wide = spark.createDataFrame([("a", *[5.0] * len(SIGNALS)), ("b", *[6.0] * len(SIGNALS)), ("c", *[7.0] * len(SIGNALS))], "file_path string, " + ", ".join(f"{k} double" for k in SIGNALS))
    signals = spark.createDataFrame([("a", "technical_quality", 8.0), ("a", "other", 1.0), ("b", "technical_quality", None), ("b", "subject_focus", float("nan")), (None, "subject_focus", 1.0)], "file_path string, signal_key string, value double")
    got = {r.file_path: r for r in with_stored_signals(wide, signals).collect()}
    assert got["a"].technical_quality == 8.0 and got["a"].subject_focus is None and got["b"].technical_quality == 6.0 and got["c"].subject_focus == 7.0
