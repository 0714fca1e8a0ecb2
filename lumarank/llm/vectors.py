"""Most similar vectors for every vector, by a permutation index.

Pivots are drawn from the vectors of each model. A vector is represented by its PERMUTATION
nearest pivots in order; it is posted in the inverted files of the first POSTED of them and
searches those of the first PROBED. Within a file, entries are ranked by the footrule distance
of the permutations (a pivot that one of them lacks counts as the next place), and only the
KEPT share that lies nearest, ties included, is reranked by exact cosine; the best of all searched
files are merged. Equal vectors are one entry of the index, with the paths that can be anyone's
neighbours, so that copies neither fill a file nor push other candidates out.

The number of pivots follows the number of vectors (one per PER_PIVOT, at most MAX_PIVOTS a
model, which bounds the sample that the driver holds and broadcasts); beyond that files grow, and
the share that is kept of each stays the same. A file with more than BLOCK entries, such as one
of a crowded place, is searched in blocks of queries by blocks of entries, each one task's work.

A posting carries the permutation and the vector in its shortest exact form (as scaled integers
where its decimals allow, else as doubles): with the few dozen numbers a vector has here that is less
than the names of the candidates that would otherwise be sent to where the vector lies.
Entries are numbered in the order of their first paths, so that a number also settles ties.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumarank.llm.expand import BROADCAST_ROWS, Blocks
from lumarank.runtime import cut, latest, parallelism

NEIGHBOURS = 5
PERMUTATION, POSTED, PROBED = 12, 4, 4
#: Share of a file's entries that the footrule leaves for the exact comparison, and the least number of them.
KEPT, LEAST_KEPT = 0.5, 64
PER_PIVOT, MIN_PIVOTS, MAX_PIVOTS = 50, 16, 16384
BLOCK = 16384
DIGITS = 6
#: Bytes of query vectors that exact_neighbours sends to every partition, at most.
EXACT_BYTES = 64 << 20
_PROBE = 1 << 62  # marks the file numbers that an entry searches


def _refuse(name: str) -> float:
    raise ValueError(name)


def usable_vector(text: str | None, dims: int) -> bytes | None:
    """The numbers of ``text`` packed without loss; None unless it is a JSON array of exactly
    ``dims`` finite numbers that aren't all zero."""
    try:
        values = json.loads(text, parse_constant=_refuse)
        if type(values) is not list or len(values) != dims or not all(type(x) in (int, float) for x in values):
            return None
        v = np.array([float(x) for x in values])
    except (ValueError, TypeError, OverflowError, RecursionError):
        return None
    return pack_vector(v) if np.isfinite(v).all() and v.any() else None


def pack_vector(v: np.ndarray) -> bytes:
    """A vector of doubles as a byte that names the form and the numbers: integers of 2 or 4 bytes
    over a power of ten if these give exactly the same doubles, else the doubles."""
    for places in range(7):
        scaled = np.rint(v * 10.0**places)
        top = np.abs(scaled).max(initial=0)
        if top >= 2**31:
            break
        if (scaled / 10.0**places == v).all():
            return bytes([places]) + scaled.astype("<i2").tobytes() if top < 2**15 else bytes([16 + places]) + scaled.astype("<i4").tobytes()
    return b"\xff" + v.astype("<f8").tobytes()


def unit_vectors(packed: list[bytes]) -> np.ndarray:
    """Packed vectors of one model, scaled to length 1."""
    rows = [np.frombuffer(b, "<f8", offset=1) if b[0] == 255 else np.frombuffer(b, "<i2" if b[0] < 16 else "<i4", offset=1) / 10.0 ** (b[0] & 15) for b in packed]
    v = np.stack(rows)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither tiny nor huge numbers leave the range when squared
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def current_vectors(cache: DataFrame, models: DataFrame) -> DataFrame:
    """``(file_path, model_key, vector binary)`` of the current, usable vectors, as ``usable_vector`` packs them.

    Current is the row of a file and model with the latest computed_at (a missing one is the
    earliest; further ties by mtime_ns, then text). Unknown models and missing paths take no part.
    """
    rows = latest(cache.filter(F.col("file_path").isNotNull() & F.col("model_key").isNotNull()), ["file_path", "model_key"], [F.col("computed_at"), F.col("mtime_ns")], ["vector_json"])
    dims = models.select("model_key", F.col("dims").cast("int").alias("dims")).filter("model_key is not null and dims > 0").groupBy("model_key").agg(F.max("dims").alias("dims"))
    rows = rows.join(dims, "model_key").select("file_path", "model_key", "vector_json", "dims")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["vector"] = [usable_vector(x, d) for x, d in zip(pdf["vector_json"], pdf["dims"])]
            yield pdf.loc[pdf["vector"].notna(), ["file_path", "model_key", "vector"]]

    return rows.mapInPandas(parse, "file_path string, model_key string, vector binary")


def _pivots(members: DataFrame, per_pivot: int, max_pivots: int) -> dict[str, tuple[int, np.ndarray]]:
    """For each model its number and a bounded sample of its distinct vectors, those of least hash.

    The sample is cut by a bound on the hash before anything is gathered, and copies are one row.
    """
    sizes = {r["model_key"]: r["n"] for r in members.groupBy("model_key").agg(F.approx_count_distinct("cid").alias("n")).collect()}
    want = {m: min(max_pivots, max(MIN_PIVOTS, n // per_pivot)) for m, n in sizes.items()}
    # three times the wanted share of evenly spread hashes, and all where there are few vectors
    bounds = [(m, min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, (3 * want[m] + 100) / n)))) for m, n in sizes.items()]
    drawn: dict[str, list] = {m: [] for m in sizes}
    if bounds:
        below = members.sparkSession.createDataFrame(bounds, "model_key string, bound bigint")  # a row per model
        sample = members.withColumn("u", F.xxhash64("cid")).join(F.broadcast(below), "model_key").filter(F.col("u") <= F.col("bound"))
        for r in sample.select("model_key", "u", "cid", "vector").dropDuplicates(["cid"]).collect():
            drawn[r["model_key"]].append((r["u"], bytes(r["cid"]), bytes(r["vector"])))
    return {m: (i, unit_vectors([v for _, _, v in sorted(drawn[m])[: want[m]]])) for i, m in enumerate(sorted(sizes))}


def _permute(pivots):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for model, own in pdf.groupby("model_key", sort=False):
                number, p = pivots.value[model]
                near = unit_vectors(own["vector"].to_list()) @ p.T
                k = min(PERMUTATION, len(p))
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
                perm = np.full((len(own), PERMUTATION), -1, dtype=np.int16)
                perm[:, :k] = np.take_along_axis(top, order, axis=1)
                files = perm[:, : min(k, POSTED)].astype(np.int64) | number << 32
                files[:, :PROBED] |= _PROBE
                yield own.assign(perm=[x.tobytes() for x in perm], files=list(files))[["no", "cid", "copies", "vector", "perm", "files"]]

    return run


def footrule_agreement(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Constant minus half the footrule distance of truncated permutations (entries by queries).

    With weights K - place (0 where a pivot lacks), the distance is the sum of |difference| =
    sum of both weights - 2 * the sum of the smaller ones; only the last term varies. A table of
    the queries' weights by pivot is read once per place of the entries. Places of -1 are empty.

    """
    k = queries.shape[1]
    known, place = np.unique(entries, return_inverse=True)
    place = place.reshape(entries.shape)
    at = np.minimum(np.searchsorted(known, queries), len(known) - 1)
    row, column = np.nonzero((known[at] == queries) & (queries >= 0))
    weights = np.zeros((len(known), len(queries)), dtype=np.int8)
    weights[at[row, column], row] = k - column
    total = np.zeros((len(entries), len(queries)), dtype=np.int8)
    for j in range(k):
        total += np.minimum(weights[place[:, j]], np.int8(k - j))
    return total


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """For the queries of a file, or of a block of it, the best entries: exact among the KEPT nearest by footrule."""
    entry, query = pdf["isd"].to_numpy(), pdf["isq"].to_numpy()
    found: dict[str, list] = {"q": [], "d": [], "c": []}
    if entry.any() and query.any():
        no, v = pdf["no"].to_numpy(), unit_vectors(pdf["vector"].to_list())
        perm = np.frombuffer(b"".join(pdf["perm"]), dtype=np.int16).reshape(len(pdf), PERMUTATION)
        numbers, dv, dp = no[entry], v[entry], perm[entry]
        kept = min(len(numbers), max(LEAST_KEPT, int(np.ceil(KEPT * len(numbers)))))
        rows = np.nonzero(query)[0]
        for start in range(0, len(rows), 256):
            part = rows[start : start + 256]
            agree = np.ascontiguousarray(footrule_agreement(perm[part], dp).T)
            least = np.partition(agree, len(numbers) - kept, axis=1)[:, len(numbers) - kept]
            for i, r in enumerate(part):
                near = np.nonzero((agree[i] >= least[i]) & (numbers != no[r]))[0]
                cos = np.round(dv[near] @ v[r], DIGITS)
                if len(near) > NEIGHBOURS + 1:
                    best = np.nonzero(cos >= np.partition(cos, -NEIGHBOURS - 1)[-NEIGHBOURS - 1])[0]
                    near, cos = near[best], cos[best]
                order = np.lexsort((numbers[near], -cos))[: NEIGHBOURS + 1]
                if len(order):
                    found["q"].append(no[r])
                    found["d"].append(numbers[near[order]])
                    found["c"].append(-cos[order])
    return pd.DataFrame({"q": np.array(found["q"], dtype=np.int64), "d": pd.Series(found["d"], dtype=object), "c": pd.Series(found["c"], dtype=object)})


def neighbour_lists(vectors: DataFrame, per_pivot: int = PER_PIVOT, max_pivots: int = MAX_PIVOTS, block: int = BLOCK) -> DataFrame:
    """``(model_key, file_path, neighbour, cos)``: the NEIGHBOURS most similar other files of each file.

    ``vectors``: ``(file_path, model_key, vector)`` with packed vectors (see pack_vector), one row
    per file and model. Similarities are rounded to DIGITS decimals, equal ones go to
    the smaller path. A file alone under its model has no rows; an empty input gives none.
    """
    if not MIN_PIVOTS <= max_pivots <= 2**15:
        raise ValueError(f"max_pivots must be {MIN_PIVOTS} to {2**15}")
    spark = vectors.sparkSession
    cid = F.unhex(F.md5(F.concat(F.encode("model_key", "utf-8"), F.lit(b"\x00"), "vector")))
    members = cut(vectors.select("file_path", "model_key", "vector", cid.alias("cid")))
    pivots = spark.sparkContext.broadcast(_pivots(members, per_pivot, max_pivots))
    classes = members.groupBy("cid", "model_key", "vector").agg(F.min("file_path").alias("first_path"), F.count("*").alias("copies"))
    ordered = classes.repartitionByRange(parallelism(spark), "first_path", "cid").sortWithinPartitions("first_path", "cid").withColumn("no", F.monotonically_increasing_id())
    indexed = cut(ordered.mapInPandas(_permute(pivots), "no bigint, cid binary, copies bigint, vector binary, perm binary, files array<bigint>"))

    posted = indexed.select("no", "vector", "perm", F.explode("files").alias("f"))
    posted = posted.select("no", "vector", "perm", F.col("f").bitwiseAND(F.lit(_PROBE - 1)).alias("file"), (F.col("f") >= _PROBE).alias("isq"))
    long = indexed.select(F.explode("files").alias("f")).groupBy(F.col("f").bitwiseAND(F.lit(_PROBE - 1)).alias("file")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    found_long = long.count()
    if not found_long:
        spots = posted.withColumn("qb", F.lit(0)).withColumn("db", F.lit(0)).withColumn("isd", F.lit(True))
    else:
        long = F.broadcast(long) if found_long <= BROADCAST_ROWS else long.hint("merge")
        placed = posted.join(long, "file", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
        cells = F.expr(
            "concat(transform(sequence(0, blocks - 1), x -> struct(x as qb, own as db, isq and x = own as isq, true as isd)),"
            " if(isq, transform(filter(sequence(0, blocks - 1), x -> x <> own), x -> struct(own as qb, x as db, true as isq, false as isd)), array()))"
        )
        spots = placed.select("no", "vector", "perm", "file", F.explode(cells).alias("c")).select("no", "vector", "perm", "file", "c.*")
    found = spots.groupBy("file", "qb", "db").applyInPandas(_search, "q bigint, d array<bigint>, c array<double>")
    each = F.flatten(F.collect_list(F.arrays_zip("c", "d")))  # a handful per file and block that was searched
    merged = found.groupBy("q").agg(F.slice(F.array_sort(F.array_distinct(each)), 1, NEIGHBOURS + 1).alias("best")).select("q", F.explode("best").alias("b")).select(F.col("q").alias("no"), "b.d", "b.c")

    # the files behind the numbers; a vector that many files share is spread over blocks
    by_cid = Blocks(members.select("cid", "file_path", "model_key"), "cid", classes=indexed.select("cid", "copies"))
    numbered = by_cid.repeated(indexed.select("cid", "no"), "cid")
    owned = cut(by_cid.placed("file_path").join(numbered.hint("merge"), ["cid", "block"]).select("no", "file_path", "model_key"))
    # of a class only the first NEIGHBOURS + 1 paths can be anyone's neighbours
    by_path = F.row_number().over(Window.partitionBy("no").orderBy("file_path"))
    firsts = owned.select("no", "file_path", by_path.alias("r")).filter(F.col("r") <= NEIGHBOURS + 1).groupBy("no").agg(F.array_sort(F.collect_list("file_path")).alias("paths"))
    others = merged.join(firsts.withColumnRenamed("no", "d").hint("merge"), "d").select("no", "c", "paths")
    own = firsts.select("no", F.lit(-1.0).alias("c"), "paths")
    # own copies and other classes compete: similarity first, then the smaller path
    ranked = others.unionByName(own).select("no", "c", F.explode("paths").alias("p")).groupBy("no").agg(F.slice(F.array_sort(F.collect_list(F.struct("c", "p"))), 1, NEIGHBOURS + 1).alias("near"))
    by_no = Blocks(owned, "no", classes=indexed.select("no", "copies"))
    lists = by_no.placed("file_path").join(by_no.repeated(ranked, "no").hint("merge"), ["no", "block"])
    mine = F.slice(F.filter("near", lambda x: x["p"] != F.col("file_path")), 1, NEIGHBOURS)
    return lists.select("model_key", "file_path", F.explode(mine).alias("n")).select("model_key", "file_path", F.col("n.p").alias("neighbour"), (-F.col("n.c")).alias("cos"))


def neighbour_pairs(cache: DataFrame, models: DataFrame) -> DataFrame:
    """``(model_key, path_a, path_b)`` with path_a < path_b: pairs of files of which one is a neighbour of the other."""
    near = neighbour_lists(current_vectors(cache, models))
    return near.select("model_key", F.least("file_path", "neighbour").alias("path_a"), F.greatest("file_path", "neighbour").alias("path_b")).distinct()


def exact_neighbours(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``(model_key, file_path, neighbour)`` by brute force for a stated set of query files.

    Used to measure recall: the queries go to every partition of the vectors, each partition keeps
    its best per query, and the best of all merge. ``queries`` has file_path and, if only some models
    are asked for, model_key. Queries of more than EXACT_BYTES are refused: state fewer, or ask in turns.
    """
    keys = [c for c in ("file_path", "model_key") if c in queries.columns]
    asked = vectors.join(queries.select(*keys).distinct().hint("merge"), keys, "left_semi").select("model_key", "file_path", "vector")
    size = asked.agg(F.sum(F.length("vector") * 8 + F.length("file_path"))).first()[0] or 0
    if size > EXACT_BYTES:
        raise ValueError(f"the queries' vectors take up to {size} bytes; at most {EXACT_BYTES} are sent to every partition")
    held: dict[str, tuple[list[str], np.ndarray]] = {}
    rows = asked.collect()
    for m in {r["model_key"] for r in rows}:
        own = [r for r in rows if r["model_key"] == m]
        held[m] = ([r["file_path"] for r in own], unit_vectors([bytes(r["vector"]) for r in own]))
    shared = vectors.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for model, own in pdf.groupby("model_key"):
                if model not in shared.value:
                    continue
                names, q = shared.value[model]
                own = own.sort_values("file_path")
                paths = own["file_path"].to_numpy()
                cos = np.round(q @ unit_vectors(own["vector"].to_list()).T, DIGITS)
                order = np.argsort(-cos, axis=1, kind="stable")[:, : NEIGHBOURS + 1]
                rows, k = np.arange(len(names))[:, None], order.shape[1]
                yield pd.DataFrame({"model_key": model, "file_path": np.repeat(names, k), "neighbour": paths[order].ravel(), "cos": cos[rows, order].ravel()})

    local = vectors.mapInPandas(run, "model_key string, file_path string, neighbour string, cos double").filter("neighbour <> file_path")
    rank = F.row_number().over(Window.partitionBy("model_key", "file_path").orderBy(F.desc("cos"), "neighbour"))
    return local.withColumn("r", rank).filter(F.col("r") <= NEIGHBOURS).select("model_key", "file_path", "neighbour")


def neighbour_recall(cache: DataFrame, models: DataFrame, every: int = 100) -> DataFrame:
    """``(model_key, queries, wanted, found, recall)``: of the true neighbours of every file whose hash is
    divisible by ``every``, against all files, those that neighbour_lists gives."""
    vectors = cut(current_vectors(cache, models))
    stated = vectors.filter(F.pmod(F.xxhash64("file_path", "model_key"), F.lit(every)) == 0).select("file_path", "model_key")
    truth = exact_neighbours(vectors, stated)
    lists = neighbour_lists(vectors).select("model_key", "file_path", "neighbour", F.lit(1).alias("hit"))
    both = truth.join(lists.hint("merge"), ["model_key", "file_path", "neighbour"], "left")
    counts = both.groupBy("model_key").agg(F.countDistinct("file_path").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return counts.withColumn("recall", F.round(F.col("found") / F.col("wanted"), 4))
