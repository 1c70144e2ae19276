"""Byte-level BPE encoding and decoding with a rank file.

A text is cut by a pattern and each piece encoded for itself: a piece that is a token
is that token; any other is searched. Its bytes stand for Latin-1 characters, so that
an Aho-Corasick tree of the tokens tells the longest one at a place. From the start the
longest token is taken that fits the one before it, shorter ones where it doesn't, and
where none fits the last token is taken back. Two tokens fit if the merges of their
joined bytes end in just these two; that is found by running the two tokens' own merges
side by side until one across the boundary would come before either, and is remembered.
The merges of a whole piece never cross a boundary whose neighbours fit (a part of the
piece is merged in the order in which it would be merged alone), so a sequence whose
neighbours all fit is the merges' own result, and there is one only. A place from which
nothing fits is never tried again, hence linear time.

Ids are little-endian unsigned 32-bit integers in one binary value (tasks run on
little-endian machines). Tokens that their own bytes' merges don't give can only be
whole pieces and aren't searched for. The rank file is read by every Python worker, so
its path must hold on each of them.

Defined results: null text is empty text, which has no ids; null ids decode to null.
Ids beyond the file raise. Strings of special tokens are ordinary text. Rows are
encoded for themselves, so repeated rows and ties come out alike; an empty table stays
empty; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a worker remembers at most before it starts anew: pieces, and pairs of tokens.
REMEMBERED = 200_000
#: Pieces of more characters are encoded each time.
LONG = 48
#: Pieces taken from a text, and rows sent on, at a time.
AT_ONCE, ROWS = 100_000, 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges(NamedTuple):
    """The merges of a token's bytes in their order: the rank of each, and the part at one end after it where it has changed, else none."""

    ranks: list[int]
    ends: list[bytes | None]


#: Above any rank.
NEVER = 1 << 60


class BytePairs:
    """A rank file's tokens, searched and checked in pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank file lacks {len(missing)} of the 256 single bytes")
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.size = list(map(len, self.bytes_of))
        self.finds = ahocorasick.Automaton()
        searched = {token: rank for token, rank in ranks.items() if len(token) == 1 or self.merged(token) == [token]}
        for token, rank in searched.items():
            self.finds.add_word(token.decode("latin-1"), rank)
        self.token = {token.decode("latin-1"): rank for token, rank in searched.items()}.get
        self.most = max(map(len, searched))
        #: The longest token that begins another one, -1 for single bytes.
        self.shorter = [-1] * len(self.bytes_of)
        for token, rank in searched.items():
            self.shorter[rank] = next((searched[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in searched), -1)
        self.known: dict[tuple[int, int], bool] = {}
        self.lefts: dict[int, Merges] = {}
        self.rights: dict[int, Merges] = {}

    def merged(self, data: bytes, told=None) -> list[bytes]:
        """The parts that are left when the pair of the least rank, of these the leftmost, is merged until none is left; ``told`` hears of each rank and the parts after it."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            least = min(found)
            if least == NEVER:
                break
            at = found.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if told:
                told(least, parts)
        return parts

    def _merges(self, rank: int, end: int) -> Merges:
        of, out = self.bytes_of[rank], Merges([], [])
        now = of[:1] if end == 0 else of[-1:]

        def told(least: int, parts: list[bytes]) -> None:
            nonlocal now
            out.ranks.append(least)
            out.ends.append(parts[end] if parts[end] != now else None)
            now = parts[end]

        self.merged(of, told)
        out.ranks.append(NEVER)
        return out

    def _run(self, a: int, b: int) -> bool:
        """Whether the merges of two tokens' joined bytes never cross the boundary."""
        left, right = self.lefts.get(a), self.rights.get(b)
        if left is None:
            left = self.lefts[a] = self._merges(a, -1)
        if right is None:
            right = self.rights[b] = self._merges(b, 0)
        rank_of = self.ranks.get
        x, y = self.bytes_of[a][-1:], self.bytes_of[b][:1]
        i = j = 0
        across = rank_of(x + y, NEVER)
        while True:
            p, q = left.ranks[i], right.ranks[j]
            # of equal ranks the leftmost pair is merged: the left token's, then the one across
            if across < p and across <= q and across < NEVER:
                return False
            if p <= q:
                if p == NEVER:
                    return True
                new, i = left.ends[i], i + 1
                if new is not None:
                    x = new
                    across = rank_of(x + y, NEVER)
            else:
                new, j = right.ends[j], j + 1
                if new is not None:
                    y = new
                    across = rank_of(x + y, NEVER)

    def fit(self, a: int, b: int) -> bool:
        told = self.known.get((a, b))
        if told is None:
            if len(self.known) >= REMEMBERED:
                self.known = {}
            told = self.known[a, b] = self._run(a, b)
        return told

    def search(self, data: bytes) -> list[int]:
        """The ids of a piece, in time linear in its length."""
        text = data.decode("latin-1")
        n, size, shorter, fit, token, most = len(data), self.size, self.shorter, self.fit, self.token, self.most
        reach = self.finds.longest_prefix
        # places that are known to be no boundary
        shut, out, at = set(), [], 0
        while at < n:
            # how far the tokens' tree goes from here; the longest token is at that depth or a little above
            ahead = text[at : at + most]
            long = reach(ahead)
            rank = token(ahead[:long])
            while rank is None:
                long -= 1
                rank = token(ahead[:long])
            while True:
                if rank < 0:
                    # no token fits here after these: the last one goes, and this place is no boundary
                    shut.add(at)
                    rank = out.pop()
                    at -= size[rank]
                elif at + size[rank] not in shut and (not out or fit(out[-1], rank)):
                    out.append(rank)
                    at += size[rank]
                    break
                rank = shorter[rank]
        return out

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return self.search(data) if whole is None else [whole]


class Codec:
    """Encodes and decodes whole texts; remembers the ids of short pieces, those met last longest."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.pairs = BytePairs(read_ranks(path))
        self.cut = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = array("I", self.pairs.piece(piece.encode())).tobytes()
        if len(piece) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known, self.before = {}, self.known
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        out, found = [], self.cut.finditer(text) if len(text) > AT_ONCE else iter(self.cut.findall(text))
        while pieces := list(islice(found, AT_ONCE)):
            if not isinstance(pieces[0], str):
                pieces = [p.group() for p in pieces]
            ids = list(map(self.known.get, pieces))
            if None in ids:
                ids = [self.known.get(p) or self._ids(p) if i is None else i for p, i in zip(pieces, ids)]
            out.append(b"".join(ids))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        of = self.pairs.bytes_of
        return b"".join(map(of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec of a rank file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ``ids`` stand for; ``decode(…, 'UTF-8')`` makes them text again where they are whole."""

    @F.pandas_udf("binary")
    def of(all_ids: pd.Series) -> pd.Series:
        decode = codec(path, pattern).decode
        return pd.Series([None if i is None else decode(i) for i in all_ids], dtype=object)

    return of(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row of ``docs``.

    Rows go through a worker once, as batches: were this a column, what reads the ids
    next would have the texts encoded again.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = codec(path, pattern).encode
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = pa.array([run(t) if t else b"" for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    coded = docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids binary")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode_documents(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of :func:`encode_documents` with ``bytes``, what their ids stand for."""
    return coded.select("*", decoded(F.col("ids"), path, pattern).alias("bytes"))


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decode_documents(encode_documents(docs, *how), *how).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )
