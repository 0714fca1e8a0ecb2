"""Score arithmetic as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumarank.constants import AESTHETIC_DIMS, AESTHETIC_SOURCE, EXPOSURE_FIELDS, EXPOSURE_PROFILES, SCENE_WEIGHTS, VISION_DIMS
from lumarank.runtime import half_up, rounded


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def falling(x: Column, soft: Column | float, hard: Column | float) -> Column:
    """10 up to ``soft``, 0 from ``hard``, linear between."""
    soft, hard = _col(soft), _col(hard)
    return F.when(x <= soft, 10.0).when(x >= hard, 0.0).otherwise(10.0 * (1.0 - (x - soft) / (hard - soft)))


def centred(x: Column, target: Column | float, tolerance: Column | float) -> Column:
    """10 at ``target``, 0 from ``tolerance`` away."""
    target, tolerance = _col(target), _col(tolerance)
    return F.when(F.abs(x - target) >= tolerance, 0.0).otherwise(10.0 * (1.0 - F.abs(x - target) / tolerance))


def rising(x: Column, bad: Column | float, good: Column | float) -> Column:
    """0 up to ``bad``, 10 from ``good``, linear between; the ramp of variances as well."""
    bad, good = _col(bad), _col(good)
    return F.when(x <= bad, 0.0).when(x >= good, 10.0).otherwise(10.0 * (x - bad) / (good - bad))


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def scaled_thresholds(soft: float, hard: float, threshold_ratio: float = 1.0, hard_ratio: float = 1.0) -> tuple[float, float]:
    """Soft and hard limit scaled by configured over default thresholds, each within [0, 0.999]."""
    limit = lambda v: min(0.999, max(0.0, v))
    low = limit(soft * threshold_ratio)
    return low, limit(max(low, low + max(0.0, hard - soft) * threshold_ratio * hard_ratio))


def _by_scene(scene: Column, values: Mapping[str, float], default: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.coalesce(scene, F.lit(""))), F.lit(default))


def exposure_score(shadow: Column, highlight: Column, p5: Column, p50: Column, p95: Column, scene: Column, over_ratio: float = 1.0, under_ratio: float = 1.0) -> Column:
    """0-10 from luminance statistics with the profile of the scene, unknown scenes with the default one."""
    rows = {}
    for name, row in EXPOSURE_PROFILES.items():
        p = dict(zip(EXPOSURE_FIELDS, row))
        p["shadow_soft"], p["shadow_hard"] = scaled_thresholds(p["shadow_soft"], p["shadow_hard"], under_ratio)
        p["highlight_soft"], p["highlight_hard"] = scaled_thresholds(p["highlight_soft"], p["highlight_hard"], over_ratio)
        rows[name] = p
    v = {f: _by_scene(scene, {k: p[f] for k, p in rows.items()}, rows["default"][f]) for f in EXPOSURE_FIELDS}
    score = (
        v["w_shadow"] * falling(shadow, v["shadow_soft"], v["shadow_hard"])
        + v["w_highlight"] * falling(highlight, v["highlight_soft"], v["highlight_hard"])
        + v["w_median"] * centred(p50, v["median_target"], v["median_tolerance"])
        + v["w_span"] * rising(F.greatest(F.lit(0.0), p95 - p5), v["span_bad"], v["span_good"])
    )
    return F.when((shadow >= 0.98) | (highlight >= 0.98), 0.0).otherwise(clamp(score, 0.0, 10.0))


def relative_focus(subject_variance: Column, whole_variance: Column) -> Column:
    """5 + 2.5 log2 of the ratio of variances, within [0, 10]; 0 where a variance isn't positive."""
    ratio = F.try_divide(subject_variance, whole_variance)
    return F.when(ratio > 0, clamp(5.0 + 2.5 * F.log2(ratio), 0.0, 10.0)).otherwise(0.0)


def heuristic_dims(brightness: Column, contrast: Column, saturation: Column, bright_share: Column, dark_share: Column, edges: Column) -> Column:
    """Struct of the seven dimensions from six image statistics in 0-1."""
    lighting = clamp(8.0 - 12.0 * F.abs(brightness - 0.48) - 15.0 * (bright_share + dark_share), 0.0, 10.0)
    color = clamp(4.5 + 8.0 * saturation, 0.0, 10.0)
    clarity = clamp(3.5 + 45.0 * edges + 8.0 * contrast, 0.0, 10.0)
    composition = clamp(5.8 + 6.0 * F.least(contrast, F.lit(0.25)), 0.0, 10.0)
    subject = clamp(0.45 * clarity + 0.35 * lighting + 1.0, 0.0, 10.0)
    depth = clamp(4.5 + 10.0 * contrast, 0.0, 10.0)
    mood = (lighting + color + depth) / 3.0
    values = dict(zip(VISION_DIMS, (subject, composition, lighting, color, clarity, depth, mood)))
    return F.struct(*[half_up(x).alias(d) for d, x in values.items()])


def mean_of_known(*values: Column) -> Column:
    """Mean of the values that aren't null, to two places; null where all are."""
    known = F.filter(F.array(*values), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, half_up(F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)))


def weighted_mean(values: Column, weights: Column, floors: Column | None = None) -> Column:
    """Mean of an array by an array of weights, lowered to each floor that its score is below.

    Null for weights that sum to 0, 0 for empty arrays.
    """
    pairs = F.zip_with(values, weights, lambda v, w: v * w)
    add = lambda a, x: a + x
    total = F.try_divide(F.aggregate(pairs, F.lit(0.0), add), F.aggregate(weights, F.lit(0.0), add))
    if floors is not None:
        caps = F.filter(F.zip_with(values, floors, lambda v, f: F.when((f > 0) & (v < f), f)), lambda x: x.isNotNull())
        total = F.when(F.size(caps) > 0, F.least(total, F.array_min(caps))).otherwise(total)
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(half_up(total))


def normalised_weights(raw: Mapping[str, float]) -> dict[str, float]:
    """Weights of the aesthetic dimensions from those of the vision dimensions, to four places; even ones if none is positive."""
    own = {d: float(raw.get(s, raw.get(d, 0.0))) for d, s in AESTHETIC_SOURCE.items()}
    total = sum(own.values())
    if total <= 0:
        return {d: round(1 / len(own), 4) for d in own}
    return {d: round(v / total, 4) for d, v in own.items()}


AESTHETIC_WEIGHTS = {scene: normalised_weights(w) for scene, w in SCENE_WEIGHTS.items()}


def scene_weight(scene: Column, dim: str, profiles: Mapping[str, Mapping[str, float]] = AESTHETIC_WEIGHTS) -> Column:
    """Weight of a dimension for the scene, with the profile ``default`` for scenes without one."""
    return _by_scene(scene, {s: float(w.get(dim, 0.0)) for s, w in profiles.items()}, float(profiles["default"].get(dim, 0.0)))


def scene_weighted(values: Mapping[str, Column], scene: Column, profiles: Mapping[str, Mapping[str, float]]) -> Column:
    """Mean of the known dimensions by the scene's weights; null if none is known."""
    num, den = F.lit(0.0), F.lit(0.0)
    for dim, value in values.items():
        w = scene_weight(scene, dim, profiles)
        num = num + F.when(value.isNotNull() & (w > 0), value * w).otherwise(0.0)
        den = den + F.when(value.isNotNull() & (w > 0), w).otherwise(0.0)
    return F.when(den > 0, num / den)


def combined_total(pixel: Column, vision: Column, pixel_weight: float = 0.3, vision_weight: float = 0.7) -> Column:
    """Both parts by weight; one alone where the other is null."""
    both = (pixel * pixel_weight + vision * vision_weight) / (pixel_weight + vision_weight)
    return half_up(F.coalesce(both, vision, pixel, F.lit(0.0)))


def screening_prior(first: Column, second: Column, third: Column, fourth: Column) -> Column:
    """Blend 0.35 / 0.30 / 0.15 / 0.20 of four scores, to four places."""
    return half_up(first * 0.35 + second * 0.30 + third * 0.15 + fourth * 0.20, 4)


def star_rating(total: Column) -> Column:
    return clamp(F.floor(total / 2 + 0.5).cast("double"), 0.0, 5.0).cast("int")


def layered_summary(df: DataFrame, scene: str = "scene", prior_weight: float = 0.10) -> DataFrame:
    """Adds ``tech focus prior aesthetic base penalty total stars decision reasons`` to wide signals.

    Columns used where present, else null: technical_quality, exposure_control,
    focus_integrity, motion_blur, noise_cleanliness, portrait_usability, subject_focus,
    screening_prior, aggregate_prior, overall_aesthetic and the six aesthetic dimensions.
    Signals are rounded to two places first, as every layer is.
    """
    have = set(df.columns)
    names = ["technical_quality", "exposure_control", "focus_integrity", "motion_blur", "noise_cleanliness", "portrait_usability", "subject_focus", "screening_prior", "aggregate_prior", "overall_aesthetic", *AESTHETIC_DIMS]
    # staged projections keep every expression small
    out = rounded(df, {f"__{n}": F.col(n) for n in names if n in have}).withColumns({f"__{n}": F.lit(None).cast("double") for n in names if n not in have})
    s = {n: F.col(f"__{n}") for n in names}
    technical = mean_of_known(s["exposure_control"], s["focus_integrity"], s["motion_blur"], s["noise_cleanliness"], s["portrait_usability"])
    out = out.withColumn("tech", F.coalesce(s["technical_quality"], technical, F.lit(0.0)))
    out = out.withColumn("focus", F.coalesce(s["subject_focus"], mean_of_known(s["focus_integrity"], s["portrait_usability"]), F.col("tech")))
    out = out.withColumn("prior", F.coalesce(s["screening_prior"], s["aggregate_prior"], F.col("tech")))
    weighted = scene_weighted({d: s[d] for d in AESTHETIC_DIMS}, F.col(scene), AESTHETIC_WEIGHTS)
    out = rounded(out, {"__weighted": weighted})
    out = out.withColumn("aesthetic", F.coalesce(s["overall_aesthetic"], F.col("__weighted"), F.lit(0.0))).drop("__weighted")
    out = rounded(out, {"base": (0.25 * F.col("tech") + 0.15 * F.col("focus") + (0.60 - prior_weight) * F.col("aesthetic") + prior_weight * F.col("prior"))})
    out = out.withColumn("__low", F.array_sort(F.filter(F.array(*[s[d] for d in AESTHETIC_DIMS]), lambda x: x.isNotNull() & (x > 0))))
    lack = lambda limit, x: F.greatest(F.lit(0.0), F.lit(limit) - x)
    # greatest() skips null, so absent places are kept out by size
    second = F.when(F.size("__low") > 1, 0.08 * lack(5.5, F.try_element_at("__low", F.lit(2)))).otherwise(0.0)
    first = F.when(F.size("__low") > 0, 0.18 * lack(6.5, F.try_element_at("__low", F.lit(1)))).otherwise(0.0)
    of_dims = F.when(s["overall_aesthetic"].isNull(), first + second).otherwise(0.0)
    out = rounded(out, {"penalty": of_dims + 0.12 * lack(6.0, F.col("tech")) + 0.10 * lack(6.0, F.col("focus"))})
    out = rounded(out, {"total": clamp(F.col("base") - F.col("penalty"), 0.0, 10.0)})
    out = out.withColumn("stars", star_rating(F.col("total")))
    return decide(out, "total", "tech", "focus", "__portrait_usability").drop(*[f"__{n}" for n in names], "__low")


def decide(df: DataFrame, total: str, tech: str, focus: str, portrait: str | None = None) -> DataFrame:
    """Adds ``decision`` and ``reasons``: weak technique rejects with reasons, the rest by total."""
    t, c, f = F.col(total), F.col(tech), F.col(focus)
    hard = F.array_compact(F.array(F.when(c < 1.5, "technical_quality_low"), F.when(f < 1.5, "subject_focus_low")))
    weak_portrait = F.lit(False) if portrait is None else F.coalesce(F.col(portrait) < 4.5, F.lit(False))
    by_total = F.when(t >= 7.5, F.when(weak_portrait, "review").otherwise("keep")).when(t >= 5.5, "review").otherwise("reject")
    none = F.array().cast("array<string>")
    out = df.withColumn("reasons", F.when(F.size(hard) > 0, hard).when((t >= 7.5) & weak_portrait, F.array(F.lit("portrait_usability_low"))).otherwise(none))
    return out.withColumn("decision", F.when((c < 1.5) | (f < 1.5), "reject").otherwise(by_total))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 for zero vectors and different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def unit_vector(v: Column) -> Column:
    """``v`` scaled to length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def expected_grade(bins: Column) -> Column:
    """Expectation of a distribution over grades 1..n, normalised first; an error if it sums to 0 or less."""
    total = F.aggregate(bins, F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.transform(bins, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, weighted / total).otherwise(F.raise_error(F.lit("empty distribution")).cast("double"))


def softmax(v: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest.

    The largest, and the sum, are bound by one-element arrays: inside the inner lambda they would
    be computed again for every element.
    """
    shifted = F.transform(F.array(F.struct(v.alias("v"), F.array_max(v).alias("top"))), lambda s: F.transform(s["v"], lambda x: F.exp(x - s["top"])))[0]
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, y: s + y)
    bound = F.transform(F.array(shifted), lambda e: F.struct(e.alias("e"), total(e).alias("sum")))
    return F.transform(bound, lambda t: F.transform(t["e"], lambda x: x / t["sum"]))[0]


def calibrated(raw: Column, scale: Column, offset: Column, pivot: float = 5.5, blend: Column | float = 1.0) -> Column:
    """Affine correction about a pivot, mixed in by ``blend``, within [1, 10]."""
    own = clamp(F.lit(pivot) + scale * (raw - pivot) + offset, 1.0, 10.0)
    return clamp(raw + _col(blend) * (own - raw), 1.0, 10.0)


def bbox_clamped(box: Column, margin: Column | float = 0.0) -> Column:
    """Box ``[x0, y0, x1, y1]`` grown by ``margin`` of its size on each side and cut to the unit square."""
    m = _col(margin)
    w, h = box[2] - box[0], box[3] - box[1]
    return F.array(*[clamp(x, 0.0, 1.0) for x in (box[0] - m * w, box[1] - m * h, box[2] + m * w, box[3] + m * h)])


def bbox_area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def bbox_coverage(inner: Column, outer: Column) -> Column:
    """Share of ``inner`` that lies in ``outer``; 0 for an empty box."""
    cut = F.array(F.greatest(inner[0], outer[0]), F.greatest(inner[1], outer[1]), F.least(inner[2], outer[2]), F.least(inner[3], outer[3]))
    return F.coalesce(F.try_divide(bbox_area(cut), bbox_area(inner)), F.lit(0.0))


def centre_closeness(box: Column) -> Column:
    """1 in the centre of the unit square, 0 in its corners."""
    dx, dy = (box[0] + box[2]) / 2 - 0.5, (box[1] + box[3]) / 2 - 0.5
    return F.greatest(F.lit(0.0), 1.0 - F.sqrt(dx * dx + dy * dy) / 0.707)


def primary_object(objects: Column) -> Column:
    """Of ``array<struct<label, confidence, bbox>>`` the one with the best subject score, ties to the later; null if empty."""
    scored = F.transform(
        objects,
        lambda o, i: F.struct(
            (0.45 * o["confidence"] + 0.35 * F.least(F.lit(1.0), bbox_area(o["bbox"]) / 0.35) + 0.20 * centre_closeness(o["bbox"]) + F.when(o["label"].isin("person", "animal"), 0.08).otherwise(0.0)).alias("score"),
            i.alias("at"),
        ),
    )
    best = F.array_max(scored)
    return F.when(F.size(objects) > 0, F.struct(F.get(objects, best["at"])["label"].alias("label"), best["score"].alias("score"), F.get(objects, best["at"])["bbox"].alias("bbox")))


def primary_face(faces: Column, person_box: Column) -> Column:
    """Of ``array<struct<confidence, bbox>>`` the index of the best face, ties to the earlier; null if empty."""
    scored = F.transform(
        faces,
        lambda f, i: F.struct(
            (0.35 * bbox_area(f["bbox"]) + 0.15 * centre_closeness(f["bbox"]) + 0.20 * f["confidence"] + 0.30 * bbox_coverage(f["bbox"], person_box)).alias("score"), (-i).alias("at")
        ),
    )
    return F.when(F.size(faces) > 0, -F.array_max(scored)["at"])


def ranked_detections(objects: Column, threshold: float, limit: int) -> Column:
    """The first ``limit`` detections with at least ``threshold`` confidence, in the given order."""
    return F.slice(F.filter(objects, lambda o: o["confidence"] >= threshold), 1, limit)


def quality_metric(value: Column, low: Column | float, high: Column | float, lower_better: Column) -> Column:
    """A metric within its range as 0-10, turned where lower is better."""
    share = clamp((value - _col(low)) / (_col(high) - _col(low)), 0.0, 1.0)
    return 10.0 * F.when(lower_better, 1.0 - share).otherwise(share)


def first_true(rules: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds: cost-ordered guards as one cascade."""
    out = F.when(*rules[0])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise(otherwise)


def scene_of_detections(labels: Column, people: Column, faces: Column) -> Column:
    """Scene from detected labels: people first, then animals, vehicles as city, food and plants as detail, else other."""
    has = lambda *names: F.arrays_overlap(labels, F.array(*[F.lit(n) for n in names]))
    return F.when((people > 0) | (faces > 0), "people").when(has("animal", "bird", "cat", "dog", "horse"), "animals").when(has("car", "bus", "train", "bicycle"), "city").when(has("food", "flower", "cup"), "detail").otherwise("other")


def landmark_area(points: Column) -> Column:
    """Area of the box around an array of ``[x, y]`` points; 0 for fewer than two."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    area = (F.array_max(xs) - F.array_min(xs)) * (F.array_max(ys) - F.array_min(ys))
    return F.when(F.size(points) >= 2, area).otherwise(0.0)


def downscale_ratio(width: Column, height: Column, longest: float) -> Column:
    """Factor that brings the longer edge to ``longest``; never enlarges."""
    return F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))


def focus_confidence(ratio: Column, source: Column) -> Column:
    """Trust in a focus measurement by its source, less for strongly reduced images."""
    base = F.when(source == "eye_roi", 0.9).when(source == "given", 0.75).when(source == "saliency", 0.35).otherwise(0.2)
    return base * F.when(ratio < 0.25, 0.8).when(ratio < 0.5, 0.9).otherwise(1.0)


def ranked_labels(labels: Column, logits: Column) -> Column:
    """``array<struct<p, label>>`` of labels by their softmax probability, greatest first, ties by label."""
    pairs = F.arrays_zip(softmax(logits).alias("p"), labels.alias("label"))
    return F.array_sort(pairs, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))


def replaced_signal(signals: Column, key: str, value: Column) -> Column:
    """An array of ``struct<signal_key, value>`` with one key replaced or added."""
    return F.concat(F.filter(signals, lambda s: s["signal_key"] != key), F.array(F.struct(F.lit(key).alias("signal_key"), value.cast("double").alias("value"))))
