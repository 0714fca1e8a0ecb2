"""Keyword-stuffed and link-list pages: bagged decision trees on content and link features,
trained on weak labels, with page predictions smoothed by the spam rate of their host.

Features describe a whole page: shares of its characters in links, in pieces (sentences or lines)
of several kinds, and counts over its words. Weak labels come from signals that look at different
things (links, repetition, tags, prose, records, length), each of which abstains unless it is sure;
a page that no signal or signals of both kinds speak for stays unlabelled. The trees are fitted on
labelled pages only and judge every page. A host's rate of spam moves the log-odds of its pages.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumarank.runtime import cut, spread

FEATURES = (
    "link_share", "links_per_word", "link_pieces", "bare_pieces", "heavy_pieces", "phrase_pieces", "echo_pieces", "prose_pieces", "record_pieces", "tag_pieces", "repeated_pieces",
    "function_share", "heavy_share", "top_share", "distinct_share", "pair_share", "separators", "sentence_marks", "digit_share", "cjk_share", "log_words", "piece_words", "packed",
)

#: Markup and addresses of links, also disguised ones; a name with a dot is a link unless it ends like a file.
_LINK = re.compile(
    r"\[/?url[^\]\n]{0,300}\]|</?a\b[^>\n]{0,500}>|\]\([^)\s]{0,500}\)|\b(?:h(?:tt|xx)ps?\s?:\s?//|www\.)[^\s\]\)<>\"']+"
    r"|(?<![\w@./])[a-z0-9][a-z0-9-]{1,62}(?:\.[a-z0-9-]{2,62}){0,3}\.(?!(?:jpe?g|png|tiff?|arw|cr[23]|nef|raf|dng|xmp|jsonl?|ya?ml|txt|md|log|py|db|csv|html?)\b)[a-z]{2,24}\b(?:[/?][^\s\]\)<>\"']*)?"
)
_DISGUISED_DOT = re.compile(r"(?<=\w)(?:\s?\[\.\]\s?|\s?\(\.\)\s?|\s+dot\s+)(?=\w)")
_LINKED = "\x02"
_TAGGED = re.compile(r"^\W{0,8}(?:[\w.#-]{1,24}\W{1,4}){0,3}?(?:tags?|labels?|keywords?|products?|categor(?:y|ies)|brand|related|etiquetas|schlagw\w+|stichw\w+|标签|关键词|タグ|キーワード)\s*[:：]|^[^\w#＃]*(?:[#＃]+\w+[^\w#＃]*)+$", re.I)
_RECORD = re.compile(
    r"(?:[\[{}\]]|\"[^\"]*\"\s*:|[-*•]?\s*\[[ xX✓]?\]|[A-Z][\w /-]{1,24}\s*[:=]\s*\S|\d{4}-\d\d-\d\d[T ]|\d\d:\d\d:\d\d|#{1,3}\s|-\s+[A-Z][a-z]+\b|(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b|[\w.]+\s*=\s)"
)
_PIECE = re.compile(r"[^\n.!?。！？|]+(?:\.(?=\S)[^\n.!?。！？|]+)*[.!?。！？]*")
_WORD = re.compile(r"[^\W\d_][^\W_]*(?:['’][^\W_]+)?")  # numbers are no words
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_CLAUSE = re.compile(r"[\u3040-\u309f\u3400-\u9fff]+")  # loan words in katakana are long on their own
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff\u0000-\u0008\u000b\u000c\u000e-\u001f\ufffd]")
#: Terminal codes and marks of model vocabularies that ended up inside words.
_MARKS = re.compile(r"\x1b\[[0-9;]*[A-Za-z]|</?s>|<(?:unk|pad|mask)>|<\|\w+\|>")
# Frequent function words of English, German and Spanish, and function characters of Chinese and Japanese.
_FUNCTION = frozenset(
    """the a an of to in on at by and or but is are was were be been it its this that these those i you he she we they my your his her our their
    not no for with from as than then so if when while until before after because although though what which who how one do does did has have had
    would could should will can may might must more most all any some every each there here about into over under between through against near
    der die das den dem des ein eine einen einem einer und oder aber ist sind war waren sein es ich du er sie wir ihr nicht kein keine für mit von
    beim man also alles etwas ob sollte trotzdem jedenfalls warum niemand kaum gegen zwei erst mehr da doch schon hier
    aus als dann so wenn weil dass was wer wie nur auch noch bei nach vor zu zum zur im am auf an um bis über unter zwischen hat haben hatte
    el la los las un una unos unas de del y o pero es son era eran ser estar está yo tú él ella nosotros no para con desde como que si cuando
    nos solo así dos antes apenas dónde cada tan ya algo nadie donde cuando pude hubo
    porque aunque más muy se me te le lo su sus mi al en por hay fue sin sobre entre hasta""".split()
)
_FUNCTION_CJK = frozenset("的了在是我有和就不都也很把这那你他她它们着过到得被让给从对与及但而或如果因为所以没再最为にをはがのでとものへやかられたてすまいせんだ")
_NO_FUNCTION_CJK = re.compile(f"[^{''.join(sorted(_FUNCTION_CJK))}]")

#: Longest CJK run of a search phrase; longer ones are clauses.
PHRASE_RUN = 6
#: Most words of a piece that merely repeats a phrase of another.
SHORT = 8


def _clean(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _INVISIBLE.sub("", _MARKS.sub("", text))
    return _DISGUISED_DOT.sub(".", text) if "dot" in text or "[.]" in text or "(.)" in text else text


def _content(key: str) -> tuple[list[str], int, int, int]:
    """Of a lower-case piece the content tokens (of CJK runs the adjacent pairs of content characters), word units, function units and longest CJK run."""
    words = _WORD.findall(key)
    tokens = [w for w in words if w not in _FUNCTION]
    units, func, run = len(words), len(words) - len(tokens), 0
    if not key.isascii() and _CJK.search(key):
        words, tokens = tokens, []
        for w in words:
            if w.isascii() or not (c := len(_CJK.findall(w))):
                tokens.append(w)
                continue
            run = max(run, max(map(len, _CLAUSE.findall(w)), default=0))
            units += max(1, c // 2) - 1
            func += len(w) - len(_NO_FUNCTION_CJK.findall(w))
            tokens += [x + y for x, y in zip(w, w[1:]) if x not in _FUNCTION_CJK and y not in _FUNCTION_CJK]
    return tokens, units, func, run


def page_features(text: str | None) -> list[float]:
    """The FEATURES of a whole text; all zero for null, empty and blank texts."""
    text = _clean(text or "")
    if not text.strip():
        return [0.0] * len(FEATURES)
    size = len(text)
    lengths: list[int] = []

    def mark(m: re.Match) -> str:
        lengths.append(m.end() - m.start())
        return _LINKED

    plain = _LINK.sub(mark, text) if "." in text or "](" in text or "<" in text or "[" in text else text
    pieces = []
    records = 0
    seen_links = all_chars = all_units = all_func = record_chars = tag_chars = 0
    tokens: list[str] = []
    near_tokens: list[tuple[str, str]] = []
    for line in plain.split("\n"):
        line = line.strip()
        if not line:
            continue
        linked, tag = _LINKED in line, bool(_TAGGED.match(line))
        if not tag and not linked and _RECORD.match(line):
            n = len(line)
            record_chars += n
            all_chars += n
            all_units += len(_WORD.findall(line))
            records += 1
            continue
        for piece in [line] if tag else _PIECE.findall(line):
            key = piece.strip().lower()
            own = key.count(_LINKED) if linked else 0
            chars = len(key) + (sum(lengths[seen_links : seen_links + own]) - own if own else 0)
            seen_links += own
            if chars <= 0:
                continue
            content, units, func, run = _content(key)
            near = list(zip(content, content[1:]))
            tokens += content
            near_tokens += near
            all_chars += chars
            all_units += units
            all_func += func
            if tag:
                tag_chars += chars
            pieces.append((chars, key, content, near, units, func, run, own, tag))
    counts, pairs = Counter(tokens), Counter(near_tokens)
    total = len(tokens)
    # tokens that a text repeats more than writing does: at least three times and 2 % of all
    least = max(3, 0.02 * total)
    heavy = {t for t, c in counts.items() if c >= least}
    known: set[str] = set()
    link = bare = in_heavy = phrase = echo = prose = repeated = 0
    for chars, key, content, near, units, func, run, own, tag in pieces:
        dense = len([1 for t in content if t in heavy]) / len(content) if heavy and content else 0.0
        function = func / units if units else 0.0
        if own and units <= 5 * own:
            link += chars
        if function < 0.12 and run <= PHRASE_RUN and (units or own):
            bare += chars
        if dense >= 0.5 and function < 0.3:
            in_heavy += chars
        again = len(near) > 1 and len(near) > len(set(near)) and any(c > 1 and pairs[x] > 2 for x, c in Counter(near).items())
        if again:
            phrase += chars
        if units <= SHORT and any([pairs[x] > 1 for x in near]):
            echo += chars
        elif not again and not tag and units > 3 * own and (function >= 0.3 or (function >= 0.2 and dense < 0.4)):
            prose += chars
        if key in known and units > 1:
            repeated += chars
        known.add(key)
    words = max(1, all_units)
    largest = sorted(counts.values())[-5:]
    raw = text.encode("utf-8", "replace")
    return [
        sum(lengths) / size,
        len(lengths) / (words + len(lengths)),
        *(n / max(1, all_chars) for n in (link, bare, in_heavy, phrase, echo, prose, record_chars, tag_chars, repeated)),
        all_func / words,
        sum(counts[t] for t in heavy) / max(1, total),
        sum(largest) / max(1, total),
        len(counts) / max(1, total),
        sum(c for c in pairs.values() if c > 2) / max(1, total),
        sum(map(plain.count, ",|/-;")) / words,
        sum(map(plain.count, ".!?。！？")) / words,
        len(re.findall(r"[0-9]", plain)) / size,
        len(_CJK.findall(text)) / size,
        float(np.log1p(all_units)),
        all_units / max(1, len(pieces) + records),
        len(zlib.compress(raw, 1)) / len(raw),
    ]


#: Rows of the weakly labelled sample that the trees are fitted on, at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LEAF = 25, 7, 3
#: How far a host's log-odds of spam move those of its pages, and pages' worth of the overall rate in a host's.
HOST_WEIGHT, HOST_PRIOR = 0.3, 20.0
SALTS = 16
_AT = {name: i for i, name in enumerate(FEATURES)}


def weak_signals(x: np.ndarray) -> np.ndarray:
    """What each signal says of each page: 1 spam, 0 no spam, -1 nothing (pages by signals)."""
    f = {name: x[:, i] for name, i in _AT.items()}
    words = np.expm1(f["log_words"])
    says = lambda kind, sure: np.where(sure, kind, -1)
    return np.stack(
        [
            says(1, (f["link_pieces"] > 0.6) & (f["link_share"] > 0.3)),  # a list of links
            says(1, (f["heavy_pieces"] > 0.65) & (f["top_share"] > 0.35) & (f["record_pieces"] < 0.1) & (words >= 12)),  # the same few words again and again
            says(1, (f["phrase_pieces"] > 0.65) & (f["pair_share"] > 0.4) & (f["record_pieces"] < 0.1) & (words >= 12)),  # phrases repeated inside sentences
            says(1, (f["echo_pieces"] > 0.6) & (f["prose_pieces"] < 0.35) & (f["record_pieces"] < 0.1) & (words >= 12)),  # short pieces that repeat phrases of each other
            says(1, (f["tag_pieces"] > 0.65) & (words >= 8)),  # lines of tags
            says(1, (f["bare_pieces"] > 0.85) & (f["function_share"] < 0.08) & (f["record_pieces"] < 0.1) & (f["distinct_share"] < 0.9) & (words >= 12)),  # phrases without sentences
            says(0, (f["prose_pieces"] > 0.7) & (f["link_share"] < 0.2)),  # sentences
            says(0, (f["record_pieces"] > 0.8) & (f["link_share"] < 0.1)),  # records, settings, check lists
            says(0, (words < 8) & (f["link_share"] == 0) & (f["tag_pieces"] == 0) & (f["repeated_pieces"] == 0)),  # remarks
            says(0, (f["function_share"] > 0.3) & (f["pair_share"] < 0.15) & (f["echo_pieces"] < 0.1) & (f["link_share"] < 0.25)),  # grammar without repetition
        ],
        axis=1,
    )


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 spam, 0 no spam, -1 where no signal speaks or signals contradict each other."""
    says = weak_signals(x)
    spam, other = (says == 1).any(axis=1), (says == 0).any(axis=1)
    return np.where(spam & ~other, 1, np.where(other & ~spam, 0, -1))


def _gini_split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[float, int, float] | None:
    best = None
    n, total = len(y), y.sum()
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= LEAF) & (n - k >= LEAF)
        if not ok.any():
            continue
        left, right = ones[:-1], total - ones[:-1]
        impurity = left * (k - left) / k + right * (n - k - right) / (n - k)
        impurity = np.where(ok, impurity, np.inf)
        at = int(impurity.argmin())
        if best is None or impurity[at] < best[0]:
            best = (float(impurity[at]), int(f), float((v[at] + v[at + 1]) / 2))
    return best


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, tree: list) -> int:
    """Appends a node (feature, threshold, left, right, probability) and returns its number."""
    at = len(tree)
    tree.append((-1, 0.0, -1, -1, float((y.sum() + 0.5) / (len(y) + 1))))
    if depth and len(y) >= 2 * LEAF and 0 < y.sum() < len(y):
        split = _gini_split(x, y, rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)])
        if split:
            _, f, t = split
            low = x[:, f] <= t
            tree[at] = (f, t, _grow(x[low], y[low], rng, depth - 1, tree), _grow(x[~low], y[~low], rng, depth - 1, tree), tree[at][4])
    return at


def fit_trees(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[list[tuple]]:
    """Decision trees on bootstrap samples; each split sees half of the features."""
    forest = []
    for t in range(TREES):
        rng = np.random.default_rng((seed, t))
        rows = rng.integers(0, len(y), len(y))
        tree: list[tuple] = []
        _grow(x[rows], y[rows], rng, DEPTH, tree)
        forest.append(tree)
    return forest


def predict_trees(forest: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    """Mean of the trees' leaf probabilities."""
    total = np.zeros(len(x))
    for tree in forest:
        feature, threshold, left, right, p = (np.array(c) for c in zip(*tree))
        node = np.zeros(len(x), dtype=int)
        for _ in range(DEPTH):
            inner = feature[node] >= 0
            go_left = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= threshold[node]
            node = np.where(inner, np.where(go_left, left[node], right[node]), node)
        total += p[node]
    return total / max(1, len(forest))


#: Hosts or texts up to which their table is broadcast; beyond, it is joined by sorting, salted.
BROADCAST_ROWS = 100_000


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features and weak label of whole texts."""
    for pdf in batches:
        x = np.array([page_features(t) for t in pdf["text"]], dtype=np.float32).reshape(-1, len(FEATURES))
        yield pd.DataFrame({"id": pdf["id"], "host": pdf["host"], "digest": pdf["digest"], "x": list(x), "weak": weak_labels(x.astype(float)).astype(np.int32)})


def _sample(rows: DataFrame, label: int, wanted: int, of: int) -> np.ndarray:
    """At most ``wanted`` different pages of a label, drawn by the hash of their features."""
    pool = rows.filter(F.col("weak") == label).select("x", F.xxhash64("x").alias("h"))
    if of > 4 * wanted:  # hashes are spread evenly, so a bound leaves about four times what is wanted
        pool = pool.filter(F.col("h") < F.lit(int(-(2**63) + 2**64 * (4 * wanted / of))))
    drawn = pool.dropDuplicates(["h"]).orderBy("h").limit(wanted).collect()
    return np.array([r["x"] for r in drawn], dtype=float).reshape(-1, len(FEATURES))


def _beside(df: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """``df`` with the columns of its row in ``few``, a table with one row per ``key``; a key may be on a third of the rows."""
    if few.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(few), key, "left")
    salted = few.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [key, "salt"], "left").drop("salt")


def _log_odds(p):
    p = F.least(F.greatest(p, F.lit(0.005)), F.lit(0.995))
    return F.log(p / (1 - p))


def spam_scores(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str | None = "source", sample_rows: int = SAMPLE_ROWS, host_weight: float = HOST_WEIGHT, held_out: DataFrame | None = None
) -> DataFrame:
    """``(id_column, page_score, host_rate, score)`` of every document.

    Features come from whole texts. The trees are fitted on the driver on at most
    ``sample_rows`` weakly labelled pages, drawn by the hash of their features, half of them
    spam where there is enough; they are applied to every row. ``score`` moves the log-odds of
    a page by those of its host's rate (shrunk towards the overall rate) against the overall rate,
    times ``host_weight``; a page without a host keeps its own. Exact copies of a text all get the
    greatest score of any. Null, empty and blank texts score 0. Repeated rows get repeated
    results; without labels of both kinds the weak label itself is the score. Pages whose ids are
    in ``held_out`` (a column of the same name) are judged but never fitted on.
    """
    host = F.lower(F.trim(F.col(f"`{host_column}`").cast("string"))) if host_column else F.lit(None).cast("string")
    kind = documents.schema[id_column].dataType.simpleString()
    rows = documents.select(F.col(f"`{id_column}`").alias("id"), F.nullif(host, F.lit("")).alias("host"), F.col(f"`{text_column}`").cast("string").alias("text"))
    rows = spread(rows.withColumn("digest", F.unhex(F.md5("text"))))
    rows = cut(rows.mapInPandas(_judge, f"id {kind}, host string, digest binary, x array<float>, weak int"))
    labelled = rows if held_out is None else rows.join(held_out.select(F.col(f"`{id_column}`").alias("id")).distinct(), "id", "left_anti")
    sizes = {r["weak"]: r["n"] for r in labelled.groupBy("weak").agg(F.count("*").alias("n")).collect()}
    drawn = [_sample(labelled, label, sample_rows // 2, sizes.get(label, 0)) for label in (0, 1)]
    forest = None
    if len(drawn[0]) and len(drawn[1]):
        forest = fit_trees(np.concatenate(drawn), np.r_[np.zeros(len(drawn[0])), np.ones(len(drawn[1]))])
    shared = documents.sparkSession.sparkContext.broadcast(forest)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["x"].to_list()).astype(float) if len(pdf) else np.empty((0, len(FEATURES)))
            p = np.maximum(weak_labels(x), 0).astype(float) if shared.value is None else predict_trees(shared.value, x)
            yield pd.DataFrame({"id": pdf["id"], "host": pdf["host"], "digest": pdf["digest"], "p": np.where(x.any(axis=1), p, 0.0)})

    scored = cut(rows.select("id", "host", "digest", "x").mapInPandas(predict, f"id {kind}, host string, digest binary, p double"))
    overall = scored.agg(F.avg("p")).first()[0] or 0.0
    rates = scored.filter("host is not null").groupBy("host").agg(((F.sum("p") + HOST_PRIOR * overall) / (F.count("*") + HOST_PRIOR)).alias("rate"))
    moved = _log_odds(F.col("p")) + host_weight * (_log_odds(F.col("rate")) - _log_odds(F.lit(overall)))
    mixed = F.when(F.col("rate").isNull() | (F.col("p") == 0), F.col("p")).otherwise(1 / (1 + F.exp(-moved)))
    mixed = _beside(scored, rates, "host", "id").select("id", "digest", "p", "rate", mixed.alias("mixed"))
    # only texts whose copies differ in score are joined back
    copies = mixed.filter("p > 0").groupBy("digest").agg(F.max("mixed").alias("best"), F.min("mixed").alias("least")).filter("best > least").select("digest", "best")
    out = _beside(mixed, copies, "digest", "id")
    return out.select(F.col("id").alias(id_column), F.col("p").alias("page_score"), F.col("rate").alias("host_rate"), F.coalesce("best", "mixed").alias("score"))


def spam_documents(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id)`` of the documents whose smoothed score is above ``threshold``."""
    scores = spam_scores(documents)
    return scores.filter(F.col("score") > threshold).select("doc_id").distinct()
