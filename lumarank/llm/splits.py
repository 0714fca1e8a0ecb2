"""Records shared across splits, by a suffix array over partitioned concatenated texts.

Every record's text, closed by a terminator, contributes all its suffixes. They are sorted by
range partitioning on a window of WINDOW characters, so that each partition holds a contiguous
piece of the suffix array. For each suffix the nearest suffix of another split above and the
nearest one below give the longest common prefix, i.e. the longest span that starts there and
occurs in another split. Spans of at least ``min_span`` characters merge into per-record coverage.
Neighbouring whole records (suffixes at the start of a record that agree to its terminator) form
a run of the array; a run with records of two splits is a class of equal records, named by its
place in the array.

The nearest suffix of another split, and the rest of a run, may lie in another partition: a first
pass takes a few rows from the edges of each. A run may cross partitions, so that a text that a
third of all records repeat is no group of its own. Partitions hold about PIECE suffixes,
whatever the size of the input, and are worked through as arrays.

The window loses nothing as long as min_span <= WINDOW: in a longer shared span every start up
to its last min_span characters has a match of its own, and their union is the whole span. A span
that the matched suffix's preceding character extends to the left is left to the suffix before.
Records longer than the window are told apart by the digest of their whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumarank.llm.expand import Blocks, expand_pairs
from lumarank.runtime import cut, parallelism, strip_blanks

WINDOW = 64
#: Suffixes in a partition, about.
PIECE = 500_000
#: Closes a record; it never occurs in a text, where it is replaced by a blank.
END = "\u0003"
_CHUNK = 50_000


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _matrix(windows: np.ndarray) -> np.ndarray:
    """Code points of the windows, a row each, filled up with 0."""
    return windows.astype(f"U{WINDOW}").view(np.uint32).reshape(len(windows), WINDOW)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of two arrays of windows."""
    out = np.empty(len(a), dtype=np.int64)
    for at in range(0, len(a), _CHUNK):
        x, y = a[at : at + _CHUNK], b[at : at + _CHUNK]
        same = _matrix(x) == _matrix(y)
        n = np.where(same.all(axis=1), WINDOW, same.argmin(axis=1))
        out[at : at + len(x)] = np.minimum(n, np.minimum([len(w) for w in x], [len(w) for w in y]))
    return out


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """The rows of a partition, which PIECE bounds."""
    parts = [pdf for pdf in batches if len(pdf)]
    return pd.concat(parts, ignore_index=True) if parts else None


def _runs(piece: pd.DataFrame) -> np.ndarray:
    """For each row the row at which its run of equal whole records starts; -1 for other suffixes."""
    code = pd.factorize(piece["h"])[0]
    starts = np.r_[True, code[1:] != code[:-1]]
    return np.where(code >= 0, np.maximum.accumulate(np.where(starts, np.arange(len(code)), 0)), -1)


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of this piece of the array, for either end: the outermost suffix and the outermost one of
    another split than that, and the run that reaches the end with (two of) its splits."""
    piece = _whole(batches)
    if piece is None:
        return
    split, part, rows = piece["s"].to_numpy(), _part(), []
    run = _runs(piece)
    for side, order in (("first", np.arange(len(piece))), ("last", np.arange(len(piece))[::-1])):
        other = np.nonzero(split[order] != split[order[0]])[0][:1]
        for place, i in enumerate([order[0], *order[other]]):
            rows.append((part, side, place, split[i], piece["w"][i], piece["c"][i], None, -1))
        start = run[order[0]]
        if start >= 0:
            for place, other in enumerate(pd.unique(split[run == start])[:2]):
                rows.append((part, side + " run", place, other, None, None, piece["h"][start], int(start) if (run == start).sum() < len(piece) else -1))
    yield pd.DataFrame(rows, columns=["part", "side", "place", "s", "w", "c", "h", "start"])


_EDGES = "part int, side string, place int, s string, w string, c string, h binary, start long"


def _outside(edges: list) -> dict[int, dict]:
    """What each partition has to know of the others: the suffixes of two splits that come before
    it and those that come after it, and, for runs that cross its ends, their name and splits."""
    by: dict[int, dict[str, list]] = {}
    for e in sorted(edges, key=lambda e: e["place"]):
        by.setdefault(e["part"], {}).setdefault(e["side"], []).append(e)
    know: dict[int, dict] = {p: {} for p in by}
    for side, store, order in (("last", "before", sorted(by)), ("first", "after", sorted(by, reverse=True))):
        near: list[tuple[str, str, str]] = []  # nearest first, of different splits
        for p in order:
            know[p][store] = near
            own = [(e["s"], e["w"], e["c"]) for e in by[p][side]]
            near = [*own, *(x for x in near if x[0] not in {s for s, _, _ in own})][:2]
    open_run: tuple[bytes, int] | None = None  # digest and name of the run at the end of the partition before
    splits: dict[int, set[str]] = {}
    for p in sorted(by):
        first, last = by[p].get("first run", []), by[p].get("last run", [])
        if first:
            name = open_run[1] if open_run and open_run[0] == bytes(first[0]["h"]) else p << 32
            know[p]["first"] = name
            splits.setdefault(name, set()).update(e["s"] for e in first)
        open_run = None
        if last:
            through = last[0]["start"] < 0  # the run is the whole partition
            name = know[p]["first"] if through or last[0]["start"] == 0 else p << 32 | last[0]["start"]
            know[p]["last"] = name
            splits.setdefault(name, set()).update(e["s"] for e in last)
            open_run = (bytes(last[0]["h"]), name)
    for own in know.values():
        own["shared"] = {name for name in (own.get("first"), own.get("last")) if name is not None and len(splits[name]) > 1}
    return know


def _spans(outside: dict[int, dict], min_span: int):
    """For each suffix the longest common prefix with its two nearest neighbours of another split;
    for each whole record, in addition, its length and the name of its run, if two splits share it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece = _whole(batches)
        if piece is None:
            return
        know, part, n = outside[_part()], _part(), len(piece)
        split, window, before = piece["s"].to_numpy(), piece["w"].to_numpy(dtype=object), piece["c"].to_numpy(dtype=object)
        at = np.arange(n)
        change = np.r_[True, split[1:] != split[:-1]]
        above = np.maximum.accumulate(np.where(change, at, 0)) - 1
        ends = np.r_[change[1:], True]
        below = np.minimum.accumulate(np.where(ends, at, n)[::-1])[::-1] + 1
        length, extends = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        for near, far in ((above, know["before"]), (below, know["after"])):
            inside = (near >= 0) & (near < n)
            other, left = np.full(n, "", dtype=object), np.full(n, None, dtype=object)
            other[inside], left[inside] = window[near[inside]], before[near[inside]]
            for i in np.nonzero(~inside)[0]:
                other[i], left[i] = next(((w, c) for s, w, c in far if s != split[i]), ("", None))
            common = _common(window, other)
            # the same character before both: the span belongs to the suffix before, which sees all of it
            longer = np.array([x is not None and x == y for x, y in zip(before, left)]) & (common < WINDOW)
            extends |= longer & (common >= length)
            better = common > length
            extends[better] = longer[better]
            length = np.maximum(length, common)
        start = _runs(piece)
        first = start >= 0
        name = np.where(first, part << 32 | np.maximum(start, 0), -1)
        per_run = pd.Series(split[first]).groupby(start[first]).nunique()
        shared = np.isin(start, per_run.index[per_run > 1])
        for end, key in ((0, "first"), (n - 1, "last")):
            if start[end] >= 0:
                own = start == start[end]
                name[own] = know[key]
                shared[own] = know[key] in know["shared"]
        kept = first | ((length >= min_span) & ~extends)
        out = pd.DataFrame({"id": piece["id"], "s": split, "o": piece["o"], "n": np.where(length >= min_span, length, 0), "length": piece["l"].astype("Int32")})
        out["run"] = pd.array(np.where(first & shared, name, -1), dtype="Int64")
        out.loc[out["run"] < 0, "run"] = pd.NA
        yield out[kept]

    return run


def shared_records(df: DataFrame, id_column: str, text_column: str, split_column: str, min_span: int = 8) -> DataFrame:
    """``(id, s, length, covered, run)`` of every record with a span shared across splits.

    ``length`` and ``covered`` count characters of the text with its terminator: covered ==
    length means that all of the record occurs in records of other splits. ``run`` names the run
    of equal whole records that holds the record, null where no record of another split is in it.
    Records with a null id, text or split take no part; an empty text is the terminator alone and
    shares nothing; repeated rows of an id add up to one. Two splits or more; ids are unique per split.
    """
    if not 1 <= min_span <= WINDOW:
        raise ValueError(f"min_span must be 1 to {WINDOW}")
    spark = df.sparkSession
    records = df.select(
        F.col(f"`{id_column}`").alias("id"),
        F.concat(F.translate(F.col(f"`{text_column}`").cast("string"), END, " "), F.lit(END)).alias("t"),
        F.col(f"`{split_column}`").cast("string").alias("s"),
    ).filter(F.col("id").isNotNull() & F.col("t").isNotNull() & F.col("s").isNotNull() & (F.length("t") > 1))
    records = cut(records.distinct())
    total = records.agg(F.sum(F.length("t").cast("bigint"))).first()[0] or 0
    starts = F.expr(f"sequence(1, greatest(length(t) - {min_span - 1}, 1))")
    suffixes = records.select("id", "s", "t", F.explode(starts).alias("o")).selectExpr(
        "id", "s", "o - 1 AS o", f"substring(t, o, {WINDOW}) AS w", "if(o > 1, substring(t, o - 1, 1), null) AS c", "if(o = 1, unhex(md5(t)), null) AS h", "if(o = 1, length(t), null) AS l"
    )
    pieces = max(parallelism(spark), -(-total // PIECE))
    ordered = cut(suffixes.repartitionByRange(pieces, "w", "h", "id").sortWithinPartitions("w", "h", "id"))
    edges = ordered.select("s", "w", "c", "h").mapInPandas(_edges, _EDGES).collect()  # eight rows a partition at most
    kind = next(f.dataType.simpleString() for f in ordered.schema.fields if f.name == "id")
    outside = spark.sparkContext.broadcast(_outside(edges))
    spans = ordered.mapInPandas(_spans_of(outside, min_span), f"id {kind}, s string, o int, n int, length int, run bigint")
    # Coverage: a position counts once, so a span adds what lies beyond the furthest end so far.
    merged = spans.groupBy("id", "s").agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("spans"), F.max("length").alias("length"), F.max("run").alias("run"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["o"] + x["n"]).alias("end"),
            (a["sum"] + F.greatest(F.lit(0), x["o"] + x["n"] - F.greatest(a["end"], x["o"]))).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return merged.select("id", "s", "length", covered.alias("covered"), "run").filter("covered > 0")


def _spans_of(outside, min_span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _spans(outside.value, min_span)(batches)

    return run


def cross_split_coverage(df: DataFrame, id_column: str, text_column: str, split_column: str, min_span: int = 8) -> DataFrame:
    """``(id_column, length, covered)`` of every record with a span shared across splits; see shared_records."""
    out = shared_records(df, id_column, text_column, split_column, min_span)
    return out.select(F.col("id").alias(id_column), "length", "covered")


#: A shoot code that closes a folder's name after an underline, else one that opens the file's
#: name, else one that closes a folder's name in any way; three groups.
_SHOOT = "^(?:.*_(s[a-z0-9]{5})/|.*/(s[a-z0-9]{5})[_\\- ]|.*(s[a-z0-9]{5})/)"
#: The first camera prefix (a letter and up to four letters or digits) with at least four digits
#: of the file's name, past a shoot code; two groups, the number without leading zeros.
_FRAME = "^(?:.*/)?(?:s[a-z0-9]{5}[_\\- ])?[^/]*?([a-z][a-z0-9]{0,4}?)[_\\-]?(?=[0-9]{4})0*([0-9]+)[^/]*$"


def label_records(labels: DataFrame) -> DataFrame:
    """``(label_id, split, source, record)``: the canonical text of each label that can overlap.

    ``record`` is ``shoot/frame#target``; the frame's number is without leading zeros. Labels without shoot code, frame or target, or of no
    split, take no part.
    """
    path = F.lower(F.translate(strip_blanks(F.col("path")), "\\", "/"))
    rows = labels.select(
        "label_id", F.lower(strip_blanks(F.col("split"))).alias("split"), "source", path.alias("path"), F.lower(strip_blanks(F.col("target"))).alias("target")
    ).filter(F.col("split").isin("train", "holdout") & F.col("label_id").isNotNull() & (F.col("target") != ""))
    # one search each: the whole path becomes what the groups hold, behind a mark that no other path has
    shoot = F.regexp_replace("path", _SHOOT + "[\\s\\S]*$", END + "$1$2$3")
    frame = F.regexp_replace("path", _FRAME, END + "$1$2")
    # written out before it is filtered, else the searches would run again for every filter on them
    rows = cut(rows.select("label_id", "split", "source", shoot.alias("shoot"), frame.alias("frame"), "target"))
    found = rows.filter(F.col("shoot").startswith(END) & F.col("frame").startswith(END))
    record = F.concat(F.substring("shoot", 2, 6), F.lit("/"), F.expr("substring(frame, 2)"), F.lit("#"), "target")
    return found.select("label_id", "split", "source", record.alias("record")).distinct()


def overlapping_labels(labels: DataFrame) -> DataFrame:
    """``(label_id, split, run)``: labels whose whole record the other split holds, by the run of
    the suffix array in which they stand together."""
    found = shared_records(label_records(labels).select("label_id", "split", "record"), "label_id", "record", "split")
    whole = found.filter(F.col("run").isNotNull() & (F.col("covered") == F.col("length")))
    return cut(whole.select(F.col("id").alias("label_id"), F.col("s").alias("split"), "run"))


def overlap_pairs(labels: DataFrame) -> DataFrame:
    """``(label_a, label_b)``: labels of the same photograph and target in train and in holdout.

    All pairs of a photograph are wanted, so the labels of each run are paired here; a run with
    many labels is spread over blocks.
    """
    rows = overlapping_labels(labels)
    train, holdout = (Blocks(rows.filter(F.col("split") == s).select("run", "label_id"), "run") for s in ("train", "holdout"))
    both = expand_pairs(train.classes.select(F.col("run").alias("a"), F.col("run").alias("b")), train, holdout, "label_id")
    return both.select(F.least("p", "q").alias("label_a"), F.greatest("p", "q").alias("label_b")).distinct()


def overlap_report(labels: DataFrame) -> DataFrame:
    """``(split, source, labels)``: labels per split and source that also occur in the other split."""
    rows = overlapping_labels(labels).select("label_id", "split")
    named = labels.select("label_id", F.lower(strip_blanks(F.col("split"))).alias("split"), "source").distinct()
    return named.join(rows.hint("merge"), ["label_id", "split"], "left_semi").groupBy("split", "source").agg(F.count("*").alias("labels"))
