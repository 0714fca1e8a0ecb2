"""Near-duplicate perceptual hashes by b-bit MinHash.

A 64-bit hash is the set of its 64 (bit position, bit value) pairs. Hashes that differ in d
bits share 64 - d of 64 + d pairs, so that at most 5 different bits mean a Jaccard similarity
of at least 59/69 = 0.855. Of ROWS * BANDS minima the low B bits are kept; a band packs ROWS of
them into a key and rows that agree in any band are candidates. A further 64 minima keep one
bit each and are packed into a word: the share of equal bits, corrected for the half that
agrees by chance, estimates the similarity of a candidate, and those far below the threshold
leave. An exact count of differing bits follows.

With 12 rows of 4 bits a pair at distance 5 shares a band with probability 0.173; all 56 bands
miss it with probability 2.4e-5 (nearer pairs far less). The estimate's floor is more than five
standard deviations below the similarity of such a pair.

Postings are exchanged once, sorted by band key, and candidates are the rows of a run of equal
keys. A run of more than BLOCK rows is handed on instead of compared: its rows are cut into
blocks, and each pair of blocks is one group of a second exchange, so that a key that a third of
all hashes share is the work of many tasks. Nothing here is left to estimates of size: the joins
that follow are merge joins, and files of a hash with many copies are spread over blocks as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumarank.functions.identity import readable_hash
from lumarank.llm.expand import Blocks, expand_pairs
from lumarank.runtime import cut, latest

ROWS, BANDS, LOW_BITS = 12, 56, 4
MAX_DISTANCE = 5
#: Least estimated Jaccard similarity of a candidate that is checked exactly.
FLOOR = 0.5
SEED = 20240229
#: Rows of a band key that one task compares; longer runs are cut into blocks of about so many.
BLOCK = 4096

_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """For each hash function, byte position and byte value the least image of that byte's eight pairs."""
    if not _TABLES:
        count = ROWS * BANDS + 64
        rng = np.random.default_rng(SEED)
        # images of the 128 pairs under a random permutation; the low bits of an image are
        # those of an independent draw, else a small minimum would tell them
        rank = np.argsort(rng.random((count, 128)), axis=1).astype(np.uint16)
        low = rng.integers(0, 256, (count, 128)).astype(np.uint16)
        image = (rank << 8 | low).reshape(count, 8, 8, 2)
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        least = image[:, :, np.arange(8), bits].min(axis=3)  # count x byte x value
        _TABLES["least"] = np.ascontiguousarray(least)
    return _TABLES


def signature_words(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x BANDS) and the word of one-bit minima (n) of 64-bit hashes."""
    least = _tables()["least"]
    hashes = hashes.astype(np.int64).view(np.uint64)
    octets = [((hashes >> np.uint64(8 * b)) & np.uint64(255)).astype(np.intp) for b in range(8)]

    def minimum(f: int) -> np.ndarray:
        m = least[f, 0][octets[0]]
        for b in range(1, 8):
            np.minimum(m, least[f, b][octets[b]], out=m)
        return m.astype(np.uint64)

    keys = np.empty((len(hashes), BANDS), dtype=np.uint64)
    mask = np.uint64((1 << LOW_BITS) - 1)
    for band in range(BANDS):
        key = np.full(len(hashes), band, dtype=np.uint64)
        for row in range(ROWS):
            key = key << np.uint64(LOW_BITS) | (minimum(band * ROWS + row) & mask)
        keys[:, band] = key
    word = np.zeros(len(hashes), dtype=np.uint64)
    for bit in range(64):
        word |= (minimum(ROWS * BANDS + bit) & np.uint64(1)) << np.uint64(bit)
    return keys.view(np.int64), word.view(np.int64)


def _post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per hash and band."""
    for pdf in batches:
        hashes = pdf["hash"].to_numpy()
        keys, word = signature_words(hashes)
        yield pd.DataFrame({"key": keys.ravel(), "hash": np.repeat(hashes, BANDS), "word": np.repeat(word, BANDS)})


def current_hashes(cache: DataFrame) -> DataFrame:
    """``(file_path, hash)`` of the current row of every file, if its hash is readable.

    Current is the row with the greatest mtime_ns (a missing one is the least). Rows without
    a file_path take no part.
    """
    rows = latest(cache.filter(F.col("file_path").isNotNull()), ["file_path"], [F.col("mtime_ns")], ["phash"])
    return rows.select("file_path", readable_hash(F.col("phash")).alias("hash")).filter(F.col("hash").isNotNull())


def estimated_similarity(word_a: np.ndarray, word_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal one-bit minima, without those equal by chance."""
    return (64.0 - np.bitwise_count((word_a ^ word_b).view(np.uint64))) / 32.0 - 1.0


def _near(hashes: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidates (i, j) those that pass the estimate, then the exact count: smaller and larger hash."""
    kept = estimated_similarity(words[i], words[j]) >= FLOOR
    i, j = i[kept], j[kept]
    a, b = hashes[i], hashes[j]
    kept = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= max_distance)
    return np.minimum(a[kept], b[kept]), np.maximum(a[kept], b[kept])


_FOUND = "hash_a bigint, hash_b bigint, key bigint, word bigint"


def _rows(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Found pairs; the other two columns are those of rows of a long run (see _runs)."""
    return pd.DataFrame({"hash_a": a, "hash_b": pd.array(b, dtype="Int64"), "key": pd.array([pd.NA] * len(a), dtype="Int64"), "word": pd.array([pd.NA] * len(a), dtype="Int64")})


def _runs(max_distance: int, block: int):
    """Compares the rows of each run of equal keys; rows of a run longer than ``block`` are handed on with their key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # the last run, which the next batch may go on with: at most block rows
        hot = None  # key of a run that is known to be long

        def compared(part: np.ndarray) -> pd.DataFrame:
            keys, hashes, words = part
            out_a, out_b = [], []
            at = np.arange(len(keys) - 1)
            step = 1
            while len(at):  # rows that lie ``step`` apart in the same run
                at = at[at + step < len(keys)]
                at = at[keys[at] == keys[at + step]]
                a, b = _near(hashes, words, at, at + step, max_distance)
                out_a.append(a)
                out_b.append(b)
                step += 1
            return _rows(np.concatenate([*out_a, np.empty(0, np.int64)]), np.concatenate([*out_b, np.empty(0, np.int64)]))

        def handed(part: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"hash_a": part[1], "hash_b": pd.array([pd.NA] * part.shape[1], dtype="Int64"), "key": pd.array(part[0], dtype="Int64"), "word": pd.array(part[2], dtype="Int64")})

        for pdf in batches:
            part = np.concatenate([*held, pdf[["key", "hash", "word"]].to_numpy(dtype=np.int64).T], axis=1)
            held = []
            if not part.shape[1]:
                continue
            if hot is not None:
                n = int(np.searchsorted(part[0], hot, "right"))
                if n:
                    yield handed(part[:, :n])
                    part = part[:, n:]
                if not part.shape[1]:
                    continue
                hot = None
            keys = part[0]
            starts = np.r_[0, np.nonzero(keys[1:] != keys[:-1])[0] + 1]
            lengths = np.diff(np.r_[starts, len(keys)])
            last = starts[-1]
            if lengths[-1] > block:
                hot = keys[-1]
            else:
                held = [part[:, last:]]
                part, lengths = part[:, :last], lengths[:-1]
            long = np.repeat(lengths > block, lengths)
            if long.any():
                yield handed(part[:, long])
            if not long.all():
                yield compared(part[:, ~long])
        for part in held:
            yield compared(part)

    return run


def _cells(max_distance: int):
    """Compares two blocks of a long run, or a block with itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, other = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        hashes, words = pdf["hash"].to_numpy(), pdf["word"].to_numpy()
        rows, columns = np.nonzero(pdf["own"].to_numpy() == own)[0], np.nonzero(pdf["own"].to_numpy() == other)[0]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for r in rows:
            against = columns[columns > r] if own == other else columns
            out.append(_near(hashes, words, np.full(len(against), r), against, max_distance))
        return pd.DataFrame({"hash_a": np.concatenate([a for a, _ in out]), "hash_b": np.concatenate([b for _, b in out])})

    return run


def near_hashes(hashes: DataFrame, max_distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """``(hash_a, hash_b, distance)`` with hash_a < hash_b of all distinct hashes at most ``max_distance`` bits apart.

    Input: a column ``hash``. Equal hashes are one value before any signature is made, so that
    copies cost nothing here. Candidates are checked where they meet and only true pairs are
    shuffled again to become distinct. ``max_distance`` is 0 to MAX_DISTANCE, for which the bands
    are laid out; null hashes take no part.
    """
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"max_distance must be 0 to {MAX_DISTANCE}: the bands would miss farther pairs")
    values = hashes.select("hash").filter(F.col("hash").isNotNull()).distinct()
    posted = values.mapInPandas(_post, "key bigint, hash bigint, word bigint")
    met = cut(posted.repartition("key").sortWithinPartitions("key").mapInPandas(_runs(max_distance, block), _FOUND))
    pairs = met.filter(F.col("key").isNull()).select("hash_a", "hash_b")
    rows = met.filter(F.col("key").isNotNull()).select("key", F.col("hash_a").alias("hash"), "word")
    blocks = cut(rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    if not blocks.isEmpty():  # long runs: every pair of blocks is a group of its own
        spread = rows.join(blocks.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int"))
        cells = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, own) as i, greatest(x, own) as j))")
        spread = spread.select("key", "hash", "word", "own", F.explode(cells).alias("c")).select("key", "hash", "word", "own", "c.i", "c.j")
        pairs = pairs.unionByName(spread.groupBy("key", "i", "j").applyInPandas(_cells(max_distance), "hash_a bigint, hash_b bigint"))
    distance = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b"))).cast("int")
    return pairs.distinct().select("hash_a", "hash_b", distance.alias("distance"))


def near_files(cache: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(path_a, path_b)`` with path_a < path_b: all files whose current hashes are near or equal.

    Every pair of files is wanted by name, so classes of equal hashes are expanded here.
    """
    files = Blocks(cut(current_hashes(cache)), "hash")
    pairs = near_hashes(files.classes, max_distance).select(F.col("hash_a").alias("a"), F.col("hash_b").alias("b"))
    same = files.classes.filter("copies > 1").select(F.col("hash").alias("a"), F.col("hash").alias("b"))
    both = expand_pairs(pairs.unionByName(same), files, files, "file_path").filter((F.col("a") != F.col("b")) | (F.col("p") < F.col("q")))
    return both.select(F.least("p", "q").alias("path_a"), F.greatest("p", "q").alias("path_b"))


def file_classes(cache: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(file_path, class_id, copies, links)``: class_id is the smallest path with an equal hash,
    copies the files of the class, links the number of other classes that are near."""
    files = Blocks(cut(current_hashes(cache)), "hash")
    names = files.members.groupBy("hash").agg(F.min("file_path").alias("class_id"), F.count("*").alias("copies"))
    ends = near_hashes(files.classes, max_distance).select(F.explode(F.array("hash_a", "hash_b")).alias("hash")).groupBy("hash").agg(F.count("*").alias("links"))
    named = names.join(ends.hint("merge"), "hash", "left").select("hash", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    spread = files.repeated(named, "hash")
    return files.placed("file_path").join(spread.hint("merge"), ["hash", "block"]).select("file_path", "class_id", "copies", "links")
