import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumarank.functions import models as M
from lumarank.functions import pixels as P
from lumarank.sources import files, manifests, sidecars
from lumarank.sources.state import StateTable, refreshed_index


def pgm(path, matrix):
    with open(path, "wb") as f:
        f.write(b"P5 %d %d 255\n" % (matrix.shape[1], matrix.shape[0]) + matrix.astype(np.uint8).tobytes())


def test_scan_decode_and_kernels(spark, tmp_path):
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, (40, 60))
    (tmp_path / "sub").mkdir()
    pgm(tmp_path / "a.pgm", noise)
    pgm(tmp_path / "sub" / "B.PGM", np.full((40, 60), 255))
    (tmp_path / "c.pgm").write_bytes(b"broken")
    (tmp_path / "d.txt").write_text("x")
    root = str(tmp_path)
    listing = files.scan_files(spark, root, ["pgm"])
    assert [os.path.basename(r.path) for r in listing.collect()] == ["a.pgm", "c.pgm", "B.PGM"]
    assert files.scan_files(spark, root, ["pgm"], 1).count() == 1
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", files.any_case_glob(["pgm"])).load(root)
    images = files.decode(content, files.decode_netpbm)
    got = {os.path.basename(r.path): r for r in images.select("path", "error", P.luminance("height", "width", "pixels").alias("l"), P.sharpness("height", "width", "pixels").alias("s"), P.image_hash("height", "width", "pixels").alias("h"), P.subject_variances("height", "width", "pixels", F.lit(None).cast("array<double>")).alias("v")).collect()}
    assert got["c.pgm"].error.startswith("ValueError") and got["c.pgm"].l.p50 is None
    assert got["B.PGM"].l.highlight == 1.0 and got["B.PGM"].s.variance == 0.0
    lum = P.luminance_stats(noise)
    assert got["a.pgm"].l.p95 == pytest.approx(lum[4]) and got["a.pgm"].s.variance > 1000 and got["a.pgm"].v.source == "saliency"


def test_pixel_kernels():
    flat = np.full((20, 20), 128, dtype=np.uint8)
    assert P.laplacian_variance(flat) == 0.0
    stripes = np.tile([0, 255], (20, 10)).astype(np.uint8)
    assert P.laplacian_variance(stripes) > 0
    assert P.to_eight_bit(np.array([[0, 65535]], dtype=np.uint16)).tolist() == [[0, 255]]
    a = np.kron(np.random.default_rng(3).integers(0, 250, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    b = np.clip(a.astype(int) + 3, 0, 255).astype(np.uint8)
    assert bin((P.perceptual_hash(a) ^ P.perceptual_hash(b)) & (2**64 - 1)).count("1") <= 4
    assert P.resized(np.ones((50, 70)), 7, 9) == pytest.approx(np.ones((7, 9)))
    assert len(P.heuristic_stats(np.zeros((4, 4, 3), dtype=np.uint8))) == 6
    box = P.saliency_box(a)
    assert 0 <= box[0] < box[2] <= 1


def test_exif_time(spark):
    text = b"2024:03:05 06:07:08\x00"
    ifd0 = struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 26) + struct.pack("<I", 0)
    sub = struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(text), 26 + 18) + struct.pack("<I", 0)
    tiff = b"II*\x00" + struct.pack("<I", 8) + ifd0 + sub + text
    assert files.exif_time(b"\xff\xd8\xff\xe1xxExif\x00\x00" + tiff) == "2024:03:05 06:07:08"
    df = spark.createDataFrame([("a", bytearray(tiff)), ("b", bytearray(b"none")), ("c", None)], "path string, content binary")
    got = {r.path: r.captured_at for r in files.capture_times(df).collect()}
    assert str(got["a"]) == "2024-03-05 06:07:08" and got["b"] is None and got["c"] is None


def test_state_table(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "state"), ["file_path"])
    row = lambda *r: spark.createDataFrame(list(r), "file_path string, score double, note string")
    assert t.clear() == 0
    t.upsert(row(("a", 1.0, "x"), ("b", 2.0, "y"), ("c", None, "z")), 1, skip_null="score")
    t.upsert(row(("a", 3.0, "x2")), 2)
    t.upsert(row(("a", 3.0, "x2")), 2)  # a repeated write changes nothing
    assert {(r.file_path, r.score) for r in t.read().collect()} == {("a", 3.0), ("b", 2.0)}
    t.update(spark.createDataFrame([("b", None, "new")], "file_path string, score double, note string"), 3)
    assert {(r.file_path, r.score, r.note) for r in t.lookup(row(("b", None, None))).collect()} == {("b", 2.0, "new")}
    t.remove(row(("a", None, None)), 4)
    assert [r.file_path for r in t.compact(str(tmp_path / "small")).read().collect()] == ["b"]
    assert t.clear() == 1 and t.read().count() == 0


def test_replace_children_and_index(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "signals"), ["file_path", "signal"])
    row = lambda *r: spark.createDataFrame(list(r), "file_path string, signal string, value double")
    t.replace_children(row(("a", "s", 1.0), ("a", "t", 2.0), ("b", "s", 3.0)), ["file_path"], 1)
    t.replace_children(row(("a", "s", 9.0)), ["file_path"], 2)
    assert {(r.file_path, r.signal, r.value) for r in t.read().collect()} == {("a", "s", 9.0), ("b", "s", 3.0)}
    old = spark.createDataFrame([("a",), ("b",)], "file_path string")
    index, gone = refreshed_index(old, spark.createDataFrame([("b",), ("c",)], "file_path string"), 2)
    assert index.count() == 2 and [r.file_path for r in gone.collect()] == ["a"]


def test_sidecars(spark, tmp_path):
    photos = spark.createDataFrame([(f"{tmp_path}/a.ARW", 4, ["pj:score=7", "Tree & <fog>"], "note")], "file_path string, rating int, tags array<string>, text string")
    (tmp_path / "b.XMP").write_text("x")
    listing = spark.createDataFrame([(f"{tmp_path}/b.XMP",)], "path string")
    extra = spark.createDataFrame([(f"{tmp_path}/b.ARW", 1, [], "")], photos.schema)
    paths = sidecars.sidecar_paths(photos.unionByName(extra), listing)
    assert {os.path.basename(r.sidecar_path) for r in paths.collect()} == {"a.xmp", "b.XMP"}
    content = sidecars.sidecar_text(F.col("rating"), F.col("tags"), F.array(F.lit("id1")), F.col("text"), F.lit("d"))
    assert sidecars.write_sidecars(paths.filter("rating = 4").withColumn("content", content)) == 1
    row = sidecars.read_sidecars(spark, str(tmp_path)).filter("rating = 4").first()
    assert row.subjects == ["Tree & <fog>"] and row.identifiers == ["id1"] and row.instructions == "note" and row.description == "d"
    df = spark.createDataFrame([("5", 5), ("4", 5)], "cur string, rec int")
    assert [r.x for r in df.select(sidecars.cleared_where_recorded(F.col("cur"), F.col("rec")).alias("x")).collect()] == [None, "4"]


def test_rewritten_sidecars_keep_what_people_tagged(spark, tmp_path):
    tags = "array<string>"
    old = spark.createDataFrame(
        [(f"{tmp_path}/a b+.xmp", ["Tree & <fog>", "pj:old"], ["id1", "pj:score=3"], ["Places|Harbor", "People|Ann"]), (f"{tmp_path}/unrelated.xmp", ["x"], [], [])],
        f"sidecar_path string, s {tags}, i {tags}, h {tags}",
    )
    text = sidecars.sidecar_text(F.lit(2), F.col("s"), F.col("i"), F.lit("n"), F.lit("d"), F.col("h"))
    assert sidecars.write_sidecars(old.withColumn("content", text)) == 2
    results = spark.createDataFrame(
        [(f"{tmp_path}/a b+.ARW", "done", 5, ["pj:score=9", "pj:rank=1"], "line", "text"), (f"{tmp_path}/new.ARW", "done", 1, None, None, None), (f"{tmp_path}/failed.ARW", "error", 1, None, None, None)],
        f"file_path string, status string, star_rating int, tags {tags}, line string, description string",
    )
    assert sidecars.rewrite_sidecars(results, sidecars.read_sidecars(spark, str(tmp_path))) == 2
    got = {os.path.basename(r.path): r for r in sidecars.read_sidecars(spark, str(tmp_path)).collect()}
    assert set(got) == {"a b+.xmp", "new.xmp", "unrelated.xmp"}
    a = got["a b+.xmp"]
    assert a.rating == 5 and a.subjects == ["Tree & <fog>"] and a.identifiers == ["id1", "pj:score=9", "pj:rank=1"] and a.hierarchical == ["Places|Harbor", "People|Ann"]
    assert got["unrelated.xmp"].subjects == ["x"] and got["new.xmp"].rating == 1 and got["new.xmp"].subjects == []


def test_label_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifests, "MAX_LABELS", 1)
    two = spark.createDataFrame([("a", "t", "train"), ("b", "t", "train")], "path string, target string, split string")
    with pytest.raises(ValueError, match="too many"):
        manifests.write_labels(two, str(tmp_path / "x.yaml"))


def test_manifests(spark, tmp_path):
    pytest.importorskip("yaml")
    good = tmp_path / "m.yaml"
    good.write_text("items:\n- {id: a, path: a.jpg, group: g, scene: city}\n- {id: b, path: b.jpg, group: g}\npreferred_by_group: {g: a}\npairwise_preferences:\n- {preferred: a, other: b}\n")
    got = manifests.read_manifest(spark, str(good))
    assert got["items"].count() == 2 and got["pairs"].first().other == "b"
    bad = tmp_path / "bad.yaml"
    bad.write_text("items:\n- {id: a, group: g}\npreferred_by_group: {h: a}\n")
    with pytest.raises(ValueError, match="isn't in group"):
        manifests.read_manifest(spark, str(bad))
    labels = tmp_path / "l.yaml"
    labels.write_text("labels:\n- {path: p, target: Dog, raw_score: 5, human_rating: 4, split: train}\n- {path: q, raw_score: 6}\n")
    df = manifests.read_labels(spark, str(labels))
    assert manifests.write_labels(df, str(tmp_path / "out.yaml"), "train") == 1
    assert manifests.read_labels(spark, str(tmp_path / "out.yaml")).first().target == "dog"
    labels.write_text("labels:\n- {path: p, raw_score: 50}\n- {raw_score: 5}\n")
    with pytest.raises(ValueError, match="label 0.*label 1"):
        manifests.read_labels(spark, str(labels))
    manifests.write_report(spark.createDataFrame([("m", 1.5)], "model string, rate double"), str(tmp_path / "r"), "T")
    assert "| m | 1.5 |" in (tmp_path / "r" / "report.md").read_text()
    old, new = spark.createDataFrame([("m", 1.0), ("n", 1.0)], "k string, v double"), spark.createDataFrame([("m", 2.0), ("n", 1.0)], "k string, v double")
    assert {(r.k, r.v) for r in manifests.best_of_both(old, new, "k", [F.col("v")]).collect()} == {("m", 2.0), ("n", 1.0)}


def test_models(spark):
    from pyspark.sql.types import ArrayType, DoubleType

    udf = M.model_udf(M.fake_runtime(4), ArrayType(DoubleType()), "fake4")
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "x string")
    rows = M.inferred_once(df, "x", udf, "m").collect()
    vectors = {r.x: r.m.value for r in rows if r.x}
    assert len(rows) == 4 and len(vectors["a"]) == 4 and vectors["a"] != vectors["b"]

    def broken():
        def run(items):
            raise RuntimeError("no model")

        return run

    bad = M.model_udf(broken, DoubleType(), "broken")
    row = df.limit(1).select(bad("x").alias("m")).first().m
    assert row.status == "fallback" and "no model" in row.error
    kept = M.screened(df, F.col("x") == "a", lambda d: d.withColumn("v", F.lit(1)))
    assert kept.filter("v = 1").count() == 2 and kept.count() == 4
