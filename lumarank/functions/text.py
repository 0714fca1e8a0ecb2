"""Text operators as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumarank.constants import ABBREVIATIONS, ALL_DIMS, LEGACY_SCENES, SCENE_KEYWORDS, SCENE_LABELS_EN, SCENE_LABELS_ZH, SCENES

# Prefixes of commentary sections.
ISSUES_PREFIX = {"zh": "【组内问题】", "en": "Group issues:"}
SHOOTING_PREFIX = {"zh": "【拍摄建议】", "en": "Shooting advice:"}
POST_PREFIX = {"zh": "【后期指导】", "en": "Post advice:"}
# What a post-processing hint must name to count as actionable, specific or about the photo.
ACTIONABLE = ("提", "压", "降", "减", "加", "裁", "校正", "拉", "控", "补", "锐化", "降噪", "白平衡", "色温", "饱和度", "对比", "阴影", "高光", "曝光", "反差")
SPECIFIC = ("阴影", "高光", "白平衡", "色温", "曝光", "饱和度", "对比", "锐化", "降噪", "裁切", "局部", "背景", "肤色", "偏色")
RELEVANT = ("阴影", "高光", "偏色", "锐化", "降噪", "背景", "裁切", "主体", "色调")
PLACEHOLDERS = ("string", "text", "todo", "tbd", "n/a", "na")
# Words that tell a scene's context in a free scene text.
STAGE_WORDS = ("舞台", "歌手", "演唱", "表演", "乐手", "主唱")
CAMP_WORDS = ("露营", "营地", "篝火", "帐篷", " camp", "Camp")
NIGHT_WORDS = ("夜", "街", "霓虹", "雨夜", "城市")
PRODUCT_WORDS = ("产品", "展台", "护肤", "展示")


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether ``text`` contains one of the words, literally."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def substring_search(text: Column, needle: str) -> Column:
    """Literal, case-insensitive (ASCII) search; the empty needle finds everything."""
    return F.lit(True) if not needle else F.lower(text).contains(needle.lower())


def label_of(key: Column, labels: dict[str, str], fallback: str | None = None) -> Column:
    """Label of a key; the fallback (else the key itself) for unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), key if fallback is None else F.lit(fallback))


def scene_label(scene: Column, language: str = "zh") -> Column:
    labels = SCENE_LABELS_EN if language == "en" else SCENE_LABELS_ZH
    return label_of(label_of(scene, LEGACY_SCENES), labels, labels["other"])


def scene_key(display: Column) -> Column:
    """Scene key of a label, key or older key; null if unknown."""
    known = {**{v: k for k, v in SCENE_LABELS_ZH.items()}, **{s: s for s in SCENES}}
    exact = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    older = F.create_map(*[F.lit(x) for kv in LEGACY_SCENES.items() for x in kv])
    return F.coalesce(F.try_element_at(exact, F.trim(display)), F.try_element_at(older, F.lower(F.trim(display))))


def is_scene_label(text: Column) -> Column:
    bare = F.trim(text)
    return F.lower(bare).isin(*sorted({*SCENES, *LEGACY_SCENES})) | bare.isin(*SCENE_LABELS_ZH.values())


def suggested_scene(raw: Column) -> Column:
    """The first scene one of whose words ``raw`` contains; null if none."""
    rules = list(SCENE_KEYWORDS.items())
    out = F.when(any_of(raw, rules[0][1]), rules[0][0])
    for scene, words in rules[1:]:
        out = out.when(any_of(raw, words), scene)
    return out


def scene_context(scene: Column, raw: Column) -> Column:
    raw = F.trim(F.coalesce(raw, F.lit("")))
    return (
        F.when(any_of(raw, STAGE_WORDS), "stage")
        .when(any_of(raw, CAMP_WORDS), "camp")
        .when((scene == "city") & any_of(raw, NIGHT_WORDS), "city_night")
        .when((scene == "detail") & any_of(raw, PRODUCT_WORDS), "product")
        .when(F.coalesce(scene, F.lit("")) == "", "default")
        .otherwise(scene)
    )


def one_decimal(x: Column) -> Column:
    """``x`` with one decimal, half up; null stays null."""
    return F.when(x.isNotNull(), F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10))


def score_line(scores: dict[str, Column], names: dict[str, str] = ABBREVIATIONS, order: Sequence[str] = ALL_DIMS) -> Column:
    """``name:value`` of the known dimensions in their order."""
    return F.concat_ws(" ", *[F.when(scores[d].isNotNull(), F.concat(F.lit(names[d] + ":"), one_decimal(scores[d]))) for d in order if d in scores])


def subject_tags(score: Column, rank: Column, size: Column, group: Column, decision: Column, boosted: Column) -> Column:
    """Machine tags of a photo, those of missing values left out."""
    tag = lambda name, x: F.concat(F.lit(f"pj:{name}="), x)
    return F.array_compact(
        F.array(
            tag("score", one_decimal(score)), tag("rank", F.concat_ws("/", rank.cast("string"), size.cast("string"))), tag("group", group),
            F.when(F.coalesce(decision, F.lit("")) != "", tag("decision", decision)), F.when(boosted, F.lit("pj:boosted")),
        )
    )


def without_prefix(text: Column, prefix: str) -> Column:
    """Trimmed text without one leading prefix."""
    body = F.trim(F.coalesce(text, F.lit("")))
    return F.when(body.startswith(prefix), F.trim(F.substring(body, len(prefix) + 1, 1 << 30))).otherwise(body)


def commentary_sections(text: Column, language: str = "zh") -> Column:
    """Struct of the text before the shooting prefix and the section from there on, empty without one."""
    prefix = SHOOTING_PREFIX[language]
    at = F.instr(text, prefix)
    shooting = F.concat(F.lit(prefix), F.trim(F.substr(text, at + len(prefix))))
    return F.struct(F.when(at > 0, F.trim(F.substr(text, F.lit(1), at - 1))).otherwise(text).alias("issues"), F.when(at > 0, shooting).otherwise("").alias("shooting"))


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[\\u4e00-\\u9fff]"))


def latin_word_count(text: Column) -> Column:
    """Runs of at least three ASCII letters between word borders."""
    return F.regexp_count(text, F.lit("(?U)\\b[a-zA-Z]{3,}\\b"))


def language_mismatch(text: Column, language: str = "zh") -> Column:
    """Whether a text is plainly not in the wanted language; empty ones match."""
    body = F.trim(F.coalesce(text, F.lit("")))
    wrong = (cjk_count(body) < 2) & (latin_word_count(body) >= 4) if language == "zh" else (cjk_count(body) >= 4) & (latin_word_count(body) < 2)
    return (body != "") & wrong


def post_quality(text: Column) -> Column:
    """Struct of five 0/1 features of a post-processing hint and their sum."""
    t = F.trim(text)
    han = cjk_count(t)
    hits = sum((F.when(t.contains(w), 1).otherwise(0) for w in SPECIFIC), F.lit(0))
    sentences = F.size(F.filter(F.split(t, "(?<=[。！？])"), lambda s: F.trim(s) != ""))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    features = {
        "format_valid": yes((t != "") & ~F.lower(t).isin(*PLACEHOLDERS) & (han >= 4)),
        "actionable": yes(any_of(t, ACTIONABLE)),
        "specificity": yes((hits >= 2) | ((F.length(t) >= 14) & (hits >= 1))),
        "photo_relevance": yes(any_of(t, RELEVANT)),
        "language_quality": yes(t.rlike("[。！？]$") & sentences.between(1, 3) & (han >= F.greatest(F.lit(4), F.floor(F.length(t) / 5)))),
    }
    return F.struct(*[c.alias(n) for n, c in features.items()], sum(features.values(), F.lit(0.0)).alias("average"))


def raw_dump(text: Column) -> Column:
    """Whether a text is a dump of values: at least three equal signs."""
    return F.length(text) - F.length(F.replace(text, F.lit("="))) >= 3


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters, digits, dot, underline and dash as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def extension(path: Column) -> Column:
    """Upper-case extension without its dot; empty for none."""
    return F.upper(F.regexp_extract(path, "[^/.]\\.([^./]+)$", 1))


def xml_escape(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def rank_sentence(rank: Column, size: Column, language: str = "zh") -> Column:
    text = "Group ranking: this photo ranks #%d out of %d photos in the group." if language == "en" else "【组内排名】这组共 %2$d 张照片，这张综合评分排第 %1$d。"
    return F.format_string(text, rank, size)


def adler32(text: Column) -> Column:
    """Adler-32 of the UTF-8 bytes, folded in the JVM."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit(".."), 0), lambda x: F.conv(x, 16, 10).cast("long"))
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    step = lambda s, x: F.struct(((s["a"] + x) % 65521).alias("a"), ((s["b"] + s["a"] + x) % 65521).alias("b"))
    return F.when(F.octet_length(text) > 0, F.aggregate(codes, start, step, lambda s: s["b"] * 65536 + s["a"])).otherwise(F.lit(1).cast("long"))


def variant(options: Sequence[str], key: Column) -> Column:
    """One of the options by the Adler-32 of ``key``; the first without a key."""
    if not options:
        return F.lit("")
    at = F.when(F.coalesce(key, F.lit("")) == "", F.lit(0)).otherwise(F.pmod(adler32(key), F.lit(len(options))).cast("int"))
    return F.get(F.array(*[F.lit(o) for o in options]), at)


def eta_text(seconds: Column) -> Column:
    """``h:mm:ss`` from an hour on, else ``m:ss``; ``--:--`` for null and negative."""
    s = F.floor(seconds).cast("long")
    long = F.format_string("%d:%02d:%02d", F.expr("0L") + F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(seconds.isNull() | (seconds < 0), "--:--").when(s >= 3600, long).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))
