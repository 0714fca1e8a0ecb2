"""Filling fixed-capacity containers with items by swap-based local search.

Items are spread over shards of bounded size. Within a shard a best-fit start is improved by
local search between underfull bins: moving an item, exchanging one for one or two for one,
always raising the sum of squared fills, until bins empty. The bins that stay underfull in
any shard meet again in a second round of bounded groups, so that what is left over is a few
bins per group of SHARD_ITEMS items of the whole collection.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumarank.llm.bpe import VOCABULARY, count_column
from lumarank.runtime import cut

#: Items that one task packs; the results of all shards are kept.
SHARD_ITEMS = 20_000
#: Search effort of a shard: exchanges looked for per underfull bin.
TRIES_PER_BIN = 40


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by size descending, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # free room and bin, sorted
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([item])
            insort(room, (capacity - size, len(bins) - 1))
        else:
            free, b = room.pop(at)
            bins[b].append(item)
            insort(room, (free - size, b))
    return bins


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int, tries_per_bin: int = TRIES_PER_BIN) -> list[list[int]]:
    """``bins`` with fewer or fuller ones: empties the emptiest underfull bins into fuller ones."""
    fill = [int(sizes[b].sum()) if b else 0 for b in bins]
    bins = [list(b) for b in bins]
    under = [i for i, f in enumerate(fill) if f < capacity]
    items = np.array([x for i in under for x in bins[i]], dtype=np.int64)
    where = np.array([i for i in under for _ in bins[i]], dtype=np.int64)
    size_of, spot = sizes[items].astype(np.int64), {int(x): k for k, x in enumerate(items)}
    free = np.zeros(len(bins), dtype=np.int64)
    free[under] = capacity - np.array([fill[i] for i in under], dtype=np.int64)
    bins_under = np.array(under, dtype=np.int64)
    held = np.array([fill[i] for i in under], dtype=np.int64)  # fills of the underfull bins
    rank = {b: k for k, b in enumerate(under)}
    stuck = np.zeros(len(under), dtype=bool)

    def put(item: int, to: int) -> None:
        at = spot[item]
        old = int(where[at])
        bins[old].remove(item)
        bins[to].append(item)
        where[at] = to
        for b, change in ((old, -int(sizes[item])), (to, int(sizes[item]))):
            fill[b] += change
            free[b] = capacity - fill[b]
            held[rank[b]] = fill[b]

    def one_step(a: int) -> bool:
        """One raising exchange that takes weight from bin ``a``; False if there is none."""
        own = sorted(bins[a], key=lambda x: -sizes[x])
        for x in own:  # move
            room = free[bins_under]
            fits = (room >= sizes[x]) & (room < capacity) & (bins_under != a)  # an emptied bin stays empty
            if fits.any():
                to = int(bins_under[np.where(fits, room, capacity + 1).argmin()])
                if fill[to] + sizes[x] > fill[a]:
                    put(x, to)
                    return True
        # one group per weight: a bin holds at most sqrt(2 * capacity) different sizes, however many items
        groups: dict[int, tuple[int, ...]] = {}
        kept = [x for i, x in enumerate(own) if i < 2 or sizes[own[i - 2]] != sizes[x]]  # at most two of a size
        for group in [(x,) for x in kept] + [(x, y) for i, x in enumerate(kept) for y in kept[i + 1 :]]:
            groups.setdefault(int(sum(sizes[x] for x in group)), group)
        room = free[where]
        best, gain = None, 0
        for weight, group in groups.items():  # one for one, two for one
            delta = weight - size_of
            good = (delta > 0) & (delta <= room) & (where != a)
            if not good.any():
                continue
            rest = np.where(good, room - delta, capacity + 1)
            k = int(rest.argmin())
            rise = int(delta[k]) * (fill[int(where[k])] - fill[a] + int(delta[k]))
            if rise > gain:
                best, gain = (group, int(items[k])), rise
        if best is None:
            return False
        group, back = best
        to = int(where[spot[back]])
        put(back, a)
        for x in group:
            put(x, to)
        return True

    tries = tries_per_bin * max(1, len(under))
    while tries > 0:
        is_open = (held > 0) & (held < capacity)
        movable = is_open & ~stuck
        if not movable.any() or is_open.sum() < 2:
            break
        a = int(bins_under[np.where(movable, held, capacity + 1).argmin()])
        while tries > 0 and bins[a]:
            tries -= 1
            if not one_step(a):
                stuck[rank[a]] = True
                break
            stuck[:] = False  # fills changed: what found no exchange before may find one now
    return [b for b in bins if b]


def _place(capacity: int, ready: bool):
    """Packs one group; with ``ready`` its items already have bins, which are improved only."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "part"], ignore_index=True)
        sizes = pdf["size"].to_numpy().astype(np.int64)
        bins = [x.tolist() for x in pdf.groupby("bin", sort=True).indices.values()] if ready else best_fit(sizes, capacity)
        bins = local_search(bins, sizes, capacity)
        number, fill = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        for n, b in enumerate(bins):
            number[b], fill[b] = n, sizes[b].sum()
        group = int(key[0]) * 2 + int(ready)
        return pdf.assign(bin=(group << 32) + number, fill=fill)[["id", "part", "size", "bin", "fill"]]

    return run


def fill_containers(sizes: DataFrame, id_column: str, size_column: str, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(id_column, part, start, size, bin_id)``: a container for every item.

    An item larger than ``capacity`` is divided into parts of that size and a rest; no other is.
    Items of size 0 take no room and come out in any container; items with a null id or a null
    or negative size take no part. Repeated (id, size) rows are separate items of the same id.
    An empty input gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = sizes.schema[id_column].dataType.simpleString()
    rows = sizes.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{size_column}`").cast("long").alias("whole")).filter("id is not null and whole >= 0")
    parts = rows.select("id", "whole", F.explode(F.expr(f"sequence(0L, greatest(whole - 1, 0L) div {capacity})")).alias("part"))
    items = parts.select("id", F.col("part").cast("int").alias("part"), F.expr(f"least({capacity}L, whole - part * {capacity})").alias("size"))
    items = cut(items)
    shards = max(1, -(-items.count() // shard_items))
    schema = f"id {kind}, part int, size bigint, bin bigint, fill bigint"
    # rows are spread by their place in the written table too, as one id may be on many rows
    placed = items.withColumn("group", F.pmod(F.xxhash64("id", "part", F.monotonically_increasing_id()), F.lit(shards))).groupBy("group").applyInPandas(_place(capacity, False), schema)
    placed = cut(placed)
    full, under = placed.filter(F.col("fill") >= capacity), placed.filter(F.col("fill") < capacity)
    groups = max(1, -(-under.count() // shard_items))
    again = under.withColumn("group", F.pmod(F.xxhash64("bin"), F.lit(groups))).groupBy("group").applyInPandas(_place(capacity, True), schema)
    return full.unionByName(again).select(
        F.col("id").alias(id_column), "part", (F.col("part").cast("long") * capacity).alias("start"), "size", F.col("bin").alias("bin_id")
    )


def window_capacity(windows: DataFrame, name: str = "standard") -> int:
    """Tokens of the named prompt window (a table of a few fixed rows)."""
    found = windows.filter(F.col("window_name") == name).agg(F.max("capacity_tokens").alias("n")).first()
    if found is None or not found["n"] or found["n"] < 1:
        raise ValueError(f"no window {name}")
    return int(found["n"])


def pack_documents(documents: DataFrame, windows: DataFrame, window: str = "standard", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, part, token_start, token_count, bin_id)``: every document's tokens in prompts of the window."""
    sizes = count_column(documents, "doc_id", "text", vocabulary)
    packed = fill_containers(sizes, "doc_id", "tokens", window_capacity(windows, window))
    return packed.select("doc_id", "part", F.col("start").alias("token_start"), F.col("size").alias("token_count"), "bin_id")


def packing_summary(packed: DataFrame, capacity: int) -> DataFrame:
    """``(bins, tokens, least_bins, overfull)`` of a packing; least_bins is the bound no packing beats."""
    bins = packed.groupBy("bin_id").agg(F.sum("token_count").alias("fill"))
    return bins.agg(
        F.count("*").alias("bins"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"), F.coalesce(F.ceil(F.sum("fill") / capacity), F.lit(0)).alias("least_bins"), F.count_if(F.col("fill") > capacity).alias("overfull")
    )
