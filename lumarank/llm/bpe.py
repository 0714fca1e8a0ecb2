"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

A piece (what the vocabulary's pattern splits off) is encoded by dynamic programming over its
prefixes: an automaton over the vocabulary gives the tokens that end at each byte, longest
first; of these exactly one can be the last token of the prefix's encoding, namely the first
one that is compatible with the last token of the prefix before it. Back-pointers from the end
give the ids. Two tokens are compatible if merging in rank order never joins bytes across
their border; that is decided by undoing their merges from the latest on.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumarank.runtime import spread

#: Default place of the vocabulary; a parameter of every function here.
VOCABULARY = os.environ.get("LUMARANK_BPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and pairs remembered by a worker; the memory is emptied beyond, results don't depend on it.
REMEMBERED = 200_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to ids of a rank file (one ``base64 id`` a line); id order is merge order."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PrefixEncoder:
    """Exact byte-level BPE by the unique last token of every prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        import regex

        self.split = regex.compile(PATTERN).findall
        self.ranks = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self._learn(token, rank)

    def _learn(self, token: bytes, rank: int) -> None:
        """The two tokens whose merge made ``token``: the last pair left by the earlier merges."""
        parts = [self.single[b] for b in token]
        joined = self.joined
        while len(parts) > 2:
            best, at = min((joined.get(p, rank), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                return  # no merge leads to this token; it can't come out of BPE
            parts[at : at + 2] = [best]
        self.halves[rank] = joined_pair = (parts[0], parts[1])
        joined[joined_pair] = rank

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE over the bytes of both tokens ends with exactly these two."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 5 * REMEMBERED:
                self.fits.clear()
            known = self.fits[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Walk back in time: before step `now` only merges of a lower rank had happened.
        # At each moment the tokens at the border mustn't have a merge that came earlier than
        # the one that took either of them away from the border.
        now = 1 << 60
        while True:
            rank = self.joined.get((left, right))
            if rank is not None and rank < now:
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                now, left = left, a[1]  # the merge to the left is the later one
            else:
                # of equal merges on both sides the left one came first, so the right one goes first
                now, right = right + 1, b[0]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        size = len(piece)
        last, width = [0] * (size + 1), [0] * (size + 1)
        fits, joined = self.fits, self._compatible
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if width[end]:
                continue  # longest first: the last token of this prefix is known
            start = end - length
            if start:
                if not width[start]:
                    continue
                before = (last[start], token)
                good = fits.get(before)
                if not (joined(*before) if good is None else good):
                    continue
            last[end], width[end] = token, length
        ids = []
        while size:
            ids.append(last[size])
            size -= width[size]
        return tuple(reversed(ids))

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty texts give the empty list."""
        ids: list[int] = []
        if not text:
            return ids
        known, add = self.known, ids.extend
        for piece in self.split(text):
            got = known.get(piece)
            if got is None:
                got = self.encode_piece(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known[piece] = got
            add(got)
        return ids


_ENCODERS: dict[str, PrefixEncoder] = {}


def _encoder(ranks: dict[bytes, int], digest: str) -> PrefixEncoder:
    """One encoder per worker process and vocabulary."""
    if digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[digest] = PrefixEncoder(ranks)
    return _ENCODERS[digest]


def _shared(df: DataFrame, vocabulary: str):
    """The rank file's bytes for all workers: a fixed vocabulary of about a megabyte, read once by the driver."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError(f"{vocabulary}: {len(raw)} bytes is no vocabulary")
    return df.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()


def _ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}


def encode_column(df: DataFrame, id_column: str, text_column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id_column, ids array<int>)`` of every row of ``df``.

    Each text is one row's work and is encoded whole; null and empty texts give the empty list;
    repeated ids give repeated rows; strings that look like special tokens are ordinary text;
    other columns are ignored. There is no shuffle, but where the scan has too few splits to
    occupy the cores.
    """
    shared, digest = _shared(df, vocabulary)
    kind = df.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _ENCODERS.get(digest) or _encoder(_ranks_of(shared.value), digest)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                ids = [np.array(encoder.encode(x), dtype=np.int32) for x in part[text_column]]
                yield pd.DataFrame({id_column: part[id_column].to_numpy(), "ids": ids})

    rows = spread(df.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")))
    return rows.mapInPandas(run, schema)


def count_column(df: DataFrame, id_column: str, text_column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id_column, tokens bigint)``: the number of ids of every text, without moving the ids."""
    shared, digest = _shared(df, vocabulary)
    kind = df.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _ENCODERS.get(digest) or _encoder(_ranks_of(shared.value), digest)
        for pdf in batches:
            yield pd.DataFrame({id_column: pdf[id_column].to_numpy(), "tokens": [len(encoder.encode(x)) for x in pdf[text_column]]})

    rows = spread(df.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")))
    return rows.mapInPandas(run, schema)
