"""Tokens against the tokenizer itself, the curve against its defining property, packing against an exact round trip."""

import json
import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from claimloom.llm import hilbert_packing as hp

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(2)
    words = ["The", "don't", "naïve", "é", "́x", "ΣΑΣ", "İx", "12", "a1b", "***", "<|endoftext|>", " y", "\x1cz", "é's", "日本", "😀", "foo.bar", " q"]
    out = ["".join(w + rng.choice([" ", "\n", "\t", "  ", "\r\n", ", "]) for w in rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)]
    return [*out, None, "", " ", "word " * 9000]


def reference(text):
    t = Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_words_give_the_same_ids():
    tokenizer = hp.WordTokenizer(PATH)
    for text, ids in zip(texts(), tokenizer.encode([t or "" for t in texts()])):
        assert [*ids.tolist(), 1] == reference(text)


def odd_texts():
    rng = random.Random(5)
    letters = [*"abcstvrelmdSTD''--..<|>/_`~{}[]019éèñßÿàÀÉÜöø÷×µªº²½İΣσςKÅ日😀́̈\x1c\x85\xa0 \x00\x7f\xad", *[" ", "\n", "  ", "'ll", "<|ENDoftext|>"] * 4, "<|endoftext|>"]
    return ["".join(rng.choices(letters, k=rng.randint(0, 200))) for _ in range(800)]


def test_odd_words_give_the_same_ids():
    tokenizer, inner = hp.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for at in range(0, 800, 50):
        part = odd_texts()[at : at + 50]
        assert [x.tolist() for x in tokenizer.encode(part)] == [inner.encode(t, add_special_tokens=False).ids for t in part]


def test_another_cut_gives_the_tokenizers_ids(tmp_path):
    state = json.load(open(PATH))
    state["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
    path = str(tmp_path / "other.json")
    (tmp_path / "other.json").write_text(json.dumps(state))
    tokenizer, inner = hp.WordTokenizer(path), Tokenizer.from_file(path)
    part = ["it's 2024, isn't it?!", *odd_texts()[:50]]
    assert [x.tolist() for x in tokenizer.encode(part)] == [inner.encode(t, add_special_tokens=False).ids for t in part]


class Watched:
    """A tokenizer that keeps what it was given."""

    def __init__(self, tokenizer, sent):
        self.tokenizer, self.sent = tokenizer, sent

    def encode_batch_fast(self, texts, **options):
        self.sent.extend(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_pieces_are_tokenized_once():
    tokenizer, sent = hp.WordTokenizer(PATH), []
    tokenizer.encode(["house tree's été"])
    for name, value in list(vars(tokenizer).items()):
        if isinstance(value, Tokenizer):
            setattr(tokenizer, name, Watched(value, sent))
    text = "House, (tree) treehouse tree's-house été."
    assert [*tokenizer.encode([text])[0].tolist(), 1] == reference(text)
    # the word that is new, and what stands around the known ones
    assert sorted(" ".join(sent).split()) == sorted([",", "(", ")", "treehouse", "-", "."])


def test_curve_is_hilbert():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.array(list(product(range(1 << bits), repeat=dims)))
        keys = hp.hilbert_key(points, bits)
        assert sorted(keys) == list(range(len(points)))
        walked = points[np.argsort(keys)]
        assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()


def test_round_trip(spark):
    rows = [(i, t, 9) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    pieces = hp.pack_documents(docs, PATH, length=256, partitions=4).collect()
    want = {i: reference(t) for i, t, _ in rows}
    spans, sequences = {}, {}
    for p in pieces:
        ids = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["length"] == len(ids) > 0 and p["doc_tokens"] == len(want[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        spans.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(spans) == set(want)
    for parts, whole in [*((v, len(want[k])) for k, v in spans.items()), *((v, None) for v in sequences.values())]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == whole if whole else at <= 256 and at & (at - 1) == 0


def test_empty(spark):
    assert hp.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
