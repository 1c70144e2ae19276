"""Packing along a space-filling curve.

Each document becomes hashed byte-trigram counts, projected by fixed random signs to
``DIMS`` numbers; their quantised grid cell's place on a Hilbert curve is its key. The
table is range-partitioned and sorted by (key, hash of id and text), so documents of
one cell, copies included, spread over as many partitions as they need; the ranges
hold about as much text each. A task walks
its partition in order, one Arrow batch at a time, tokenizes and cuts the stream of
ids every ``length``; neighbours on the curve share sequences. What is left at a
partition's end is cut into sequences whose sizes are powers of two, so there is no
padding at all and no task needs another's offsets.

Defined results: null text is empty text, which has the end id alone. Repeated rows
are packed once each. An empty table gives no pieces. Whole texts are tokenized as the
tokenizer itself does it: the string of a special token gives that token's id. Other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.features import gram_counts

BITS, DIMS, CELL_BITS = 10, 4, 8
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words that a worker remembers the ids of before it starts anew.
REMEMBERED = 600_000
_MARK = re.compile("[\u0300-\u036f]")
#: How the tokenizer cuts a text, and the same for lower-cased words of ASCII and Latin-1 letters in UTF-8, with a line feed between two.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SIMPLE = re.compile(rb"(?:[!-~\n]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PIECES = re.compile(rb"\n|'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-/:-`{-~]+")
#: The character that stands for a byte, but for the space, in the tokenizer's vocabulary.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED))) if b != 0x20}


def hilbert_key(cells: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of grid coordinates (Skilling's transform, a row a point)."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[:, i] & q) > 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[:, -1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def grid_cells(texts: list[str | None]) -> np.ndarray:
    """Grid coordinates of texts: projected unit count vectors, evenly quantised over the range that they fill."""
    signs = np.random.default_rng(20240301).choice(np.array([-1, 1], np.float32), (1 << BITS, DIMS))
    x = np.stack([np.log1p(gram_counts(t.encode("utf-8", "surrogatepass") if t else b"", BITS)) for t in texts])
    length = np.linalg.norm(x, axis=1, keepdims=True)
    y = (x / np.where(length > 0, length, 1)) @ signs
    # a unit vector's projections by random signs stay within a few units
    return np.clip((y / 4 + 0.5) * (1 << CELL_BITS), 0, (1 << CELL_BITS) - 1).astype(np.int64)


def curve_places(texts: pd.Series, ties: pd.Series) -> np.ndarray:
    """Each text's place on the curve, and behind it 31 bits of ``ties``."""
    keys = [hilbert_key(grid_cells(texts.iloc[at : at + 1024].tolist())) for at in range(0, len(texts), 1024)]
    return (np.concatenate(keys) << 31) | (ties.to_numpy() & 0x7FFFFFFF)


def along_curve(docs: DataFrame, partitions: int, sampled: int = 100) -> DataFrame:
    """``docs`` with ``place`` and ``part``: ranges of the curve that hold about as much text each.

    The bounds come from about ``sampled`` rows a partition, a million at most, and
    decide the balance alone; copies differ in their tie, so no range is one place.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("tie"))

    @F.pandas_udf("long")
    def place(texts: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(curve_places(texts, ties) if len(texts) else np.empty(0, np.int64))

    wanted = min(sampled * partitions, 1_000_000)
    share = min(1.0, wanted / max(1, docs.count()))
    seen = rows.sample(share, seed=17).select(place("text", "tie").alias("place"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).toArrow().sort_by("place")
    weight = np.cumsum(seen.column("size").to_numpy() + 64.0)
    at = np.searchsorted(weight, weight[-1] * np.arange(1, partitions) / partitions) if len(weight) else []
    bounds = seen.column("place").to_numpy()[at]

    @F.pandas_udf("place long, part int")
    def ranged(texts: pd.Series, ties: pd.Series) -> pd.DataFrame:
        places = curve_places(texts, ties) if len(texts) else np.empty(0, np.int64)
        return pd.DataFrame({"place": places, "part": np.searchsorted(bounds, places, "right").astype(np.int32)})

    return rows.withColumn("on", ranged("text", "tie")).select("doc_id", "text", "on.place", "on.part")


class WordTokenizer:
    """Ids of whole texts, word by word: the tokenizer drops white space and never merges across it, so a word's ids don't depend on its neighbours.

    New words of ASCII and Latin-1 letters are cut as the tokenizer cuts them, and only
    pieces that are new go to its merges, many at a time, as the bytes' own characters. Other new
    words go through all of it, many at a time, with a special token between two of them. A
    text that holds a special token's own string is tokenized whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.inner = Tokenizer.from_file(path)
        self.special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.mark = self.inner.id_to_token(max(self.inner.get_added_tokens_decoder()))
        self.mark_id = self.inner.token_to_id(self.mark)
        self.cuts = _cuts_as_here(self.inner)
        self.merges = Tokenizer(self.inner.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # each piece's last token, and no other, has the suffix
        suffix = self.inner.model.end_of_word_suffix
        self.last = np.zeros(self.inner.get_vocab_size(with_added_tokens=True), bool)
        self.last[[i for t, i in self.inner.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        if self.cuts:
            words = [w for at in range(0, len(words), 4096) for w in self._learn_simple(words[at : at + 4096])]
        # a word that holds a part of a special token's string, or becomes one in lower case, goes alone, as ordinary text
        alone = [w for w in words if b"<|" in w or b"|>" in w]
        for w, e in zip(alone, self.plain.encode_batch_fast([_text(w) for w in alone], add_special_tokens=False)):
            self.known[w] = np.array(e.ids, "<u4").tobytes()
        rest = [w for w in words if w not in self.known]
        for at in range(0, len(rest), 512):
            part = rest[at : at + 512]
            ids = np.array(self.inner.encode_batch_fast([self.mark.join(map(_text, part))], add_special_tokens=False)[0].ids, "<u4")
            self._remember(part, ids, np.flatnonzero(ids == self.mark_id), 1)

    def _learn_simple(self, words: list[bytes]) -> list[bytes]:
        """Learns the simple ones of ``words``; the others are returned."""
        lines, others = b"\n".join(words), []
        if not _SIMPLE.fullmatch(lines):
            others = [w for w in words if not _SIMPLE.fullmatch(w)]
            words = [w for w in words if _SIMPLE.fullmatch(w)]
            lines = b"\n".join(words)
        new = list(set(_pieces(lines)).difference(self.known, (b"\n",)))
        for at in range(0, len(new), 512):
            block = new[at : at + 512]
            ids = np.array(self.merges.encode_batch_fast([b" ".join(block).decode("latin-1").translate(_BYTE_CHARS)], add_special_tokens=False)[0].ids, "<u4")
            self._remember(block, ids, np.flatnonzero(self.last[ids])[:-1] + 1, 0)
        # words of one piece, in small letters, are known by now
        if words := [w for w in words if w not in self.known]:
            between = np.array([self.mark_id], "<u4").tobytes()
            ids = np.frombuffer(b"".join([between if p == b"\n" else self.known[p] for p in _pieces(b"\n".join(words))]), "<u4")
            self._remember(words, ids, np.flatnonzero(ids == self.mark_id), 1)
        return others

    def _remember(self, words: list[bytes], ids: np.ndarray, cuts: np.ndarray, gap: int) -> None:
        """The ids of ``words`` are those between ``cuts``, each of which takes ``gap`` ids."""
        if len(cuts) != max(0, len(words) - 1):
            raise ValueError("the tokenizer's ids don't part into its words")
        data, starts = ids.tobytes(), [0, *(4 * (cuts + gap)).tolist()]
        self.known.update((w, data[a:b]) for w, a, b in zip(words, starts, [*(4 * cuts).tolist(), len(data)]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        split: list[list[bytes] | None] = []
        for t in texts:
            if any(s in t for s in self.special):
                split.append(None)
                continue
            data = t.encode("utf-8", "surrogatepass")
            # the tokenizer lower-cases; letters A-Z can be lowered first unless a mark could combine with them
            split.append((data.lower() if t.isascii() or not _MARK.search(t) else data).split())
        self.learn(list(set().union(*filter(None, split)).difference(self.known)))
        ids_of = self.known.__getitem__
        return [
            np.array(self.inner.encode(t, add_special_tokens=False).ids, "<u4") if words is None else np.frombuffer(b"".join(map(ids_of, words)), "<u4")
            for t, words in zip(texts, split)
        ]


def _cuts_as_here(tokenizer) -> bool:
    """Whether ``tokenizer`` lower-cases and cuts simple words as ``_PIECES`` does, and gives each piece one last token."""
    state = json.loads(tokenizer.to_str())
    model = state["model"]
    steps = [(s["type"], s.get("pattern"), s.get("behavior"), s.get("invert"), s.get("add_prefix_space"), s.get("use_regex")) for s in (state["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return (
        [s["type"] for s in (state["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and state["normalizer"]["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        and steps == [("Split", {"Regex": _CUT}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
        and model["type"] == "BPE"
        and bool(model["end_of_word_suffix"])
        and not (model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"])
        and all(c in model["vocab"] and c + model["end_of_word_suffix"] in model["vocab"] for c in _BYTE_CHARS.values())
        and not any(model["end_of_word_suffix"] in t[: -len(model["end_of_word_suffix"])] for t in model["vocab"])
    )


def _pieces(lines: bytes) -> list[bytes]:
    return _PIECES.findall(_text(lines).lower().encode())


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def sequence_sizes(left: int, length: int) -> list[int]:
    """Sizes of the sequences that take the last ``left`` (< length) ids: powers of two, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if left >> b & 1]


def _tail_cuts(left: int, length: int) -> np.ndarray:
    return np.cumsum([0, *sequence_sizes(left, length)])


def packer(tokenizer_path: str, length: int, end_id: int):
    """The function that packs one partition's rows, in their order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4")
        open_rows: list[tuple] = []  # documents' pieces in the sequence that isn't full yet
        filled, sequence = 0, 0

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces)) if pieces else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            out: list[tuple] = []
            ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for part in range(0, len(texts), 256):
                encoded = tokenizer.encode([t or "" for t in texts[part : part + 256]])
                for doc_id, found in zip(ids_of[part : part + 256], encoded):
                    ids = np.concatenate([found, end])
                    n, start = len(ids), 0
                    while start < n:
                        take = min(n - start, length - filled)
                        open_rows.append((doc_id, start, ids[start : start + take], n, filled))
                        start, filled = start + take, filled + take
                        if filled == length:
                            out += [(d, s, len(x), zlib.crc32(x.tobytes()), m, base + sequence, o) for d, s, x, m, o in open_rows]
                            open_rows, filled, sequence = [], 0, sequence + 1
            yield rows(out)
        # the rest: cut anew at sizes that are powers of two
        out = []
        edges = _tail_cuts(filled, length)
        for d, s, x, m, o in open_rows:
            taken = 0
            while taken < len(x):
                k = int(np.searchsorted(edges, o + taken, "right")) - 1
                piece = x[taken : taken + int(edges[k + 1]) - o - taken]
                out.append((d, s + taken, len(piece), zlib.crc32(piece.tobytes()), m, base + sequence + k, o + taken - int(edges[k])))
                taken += len(piece)
        yield rows(out)

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of all rows of ``docs``."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = along_curve(docs, n).repartitionById(n, "part").sortWithinPartitions("place").select("doc_id", "text")
    return ordered.mapInArrow(packer(tokenizer_path, length, end_id), PIECES)


def op6_hilbert_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
