import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from claimloom.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return byte_bpe.Codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_equals_the_library_on_random_texts(own, theirs):
    r = random.Random(11)
    kinds = ["ab", "aeiou", " \t\n\r\x0b\x1c\x85 　ab", "éèñ日本語中", "abcdefghijklmnopqrstuvwxyz", "ABc012 !?'s't're", "\U0001f600‍́a ", "<|endoftext|> "]
    for _ in range(3000):
        text = "".join(r.choice(r.choice(kinds)) for _ in range(r.choice([1, 5, 40, 200])))
        assert ids(own, text) == theirs.encode_ordinary(text)
        assert own.decode(own.encode(text)).decode() == text


def test_every_block_of_code_points(own, theirs):
    for i in range(0, 0x110000, 7):
        if not 0xD800 <= i < 0xE000:
            text = f"a{chr(i)}1{chr(i)} {chr(i)}"
            assert ids(own, text) == theirs.encode_ordinary(text), hex(i)


@pytest.mark.parametrize("text", ["a" * 150_000, "ab" * 60_000, "日本" * 30_000, " " * 120_000, "x y" * 120_000])
def test_long_texts_and_long_pieces(own, theirs, text):
    found = own.encode(text)
    assert own.decode(found).decode() == text
    # the library itself takes quadratic time on one piece
    assert ids(own, text[:3000]) == theirs.encode_ordinary(text[:3000])


def test_any_rank_file_even_with_tokens_that_no_merge_gives():
    r = random.Random(5)
    for trial in range(60):
        ranks = {bytes([b]): i for i, b in enumerate(range(256))}
        while len(ranks) < 256 + 25:
            token = bytes(r.choice(b"abc") for _ in range(r.randint(2, 6)))
            ranks.setdefault(token, len(ranks))
        theirs = tiktoken.Encoding("toy", pat_str=r"[a-c]+", mergeable_ranks=ranks, special_tokens={})
        pairs = byte_bpe.BytePairs(ranks)
        for _ in range(60):
            text = "".join(r.choice("abc") for _ in range(r.randint(1, 40)))
            assert pairs.piece(text.encode()) == theirs.encode_ordinary(text), (trial, text)


def test_a_file_without_all_bytes_raises():
    with pytest.raises(ValueError):
        byte_bpe.BytePairs({b"a": 0})


def test_rows_with_nulls_repeats_and_clashing_names(spark, theirs):
    rows = [(1, "Hello wörld", "x"), (2, None, "x"), (3, "", None), (3, "", None), (None, "a  b", "y"), (7, "Hello wörld", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("*", "1 as n_tokens", "text as bytes")
    coded = byte_bpe.encode_documents(docs, PATH, P.PATTERN)
    got = byte_bpe.decode_documents(coded, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes).decode()) for r in got) == sorted(
        (i or -1, len(theirs.encode_ordinary(t or "")), theirs.encode_ordinary(t or ""), t or "") for i, t, _ in rows
    )
    assert byte_bpe.encode_documents(docs.limit(0), PATH, P.PATTERN).count() == 0
