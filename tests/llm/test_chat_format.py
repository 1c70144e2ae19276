"""Digests against plain ones, escapes both ways, typed parts."""

import hashlib
import random
import subprocess
import sys

import pytest

from claimloom.llm import chat_format as cf


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests(spark):
    rng = random.Random(4)
    bits = ["</s>", "<s>", "[INST]", "\\", "\\<", "a", "é😀", "\n", "<|image:0|>", "]", "[/INST] ok", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to]ol", "assistant"]), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(50, 0, "user", None), (50, 1, "assistant", None), (51, 0, "assistant", "same"), (51, 0, "assistant", "same"), (52, t := 0, None, "x")]
    # ties go by content, not by what the escape makes of it
    rows += [(70, 0, "user", t) for t in ("<a", "Za", "[b", "\\c", "z")]
    rows += [(60, i, "assistant", "long " * 50) for i in range(3000)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame([(*r, 1) for r in shuffled], "conv_id long, turn long, role string, text string, head int").withColumn("content", cf.text_part(cf.F.col("text")))
    got = {r["conv_id"]: tuple(r)[1:5] for r in cf.conversation_digests(cf.format_turns(df)).collect()}
    for conv in {r[0] for r in rows}:
        mine = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        mine = sorted(mine) if conv == 70 else mine
        loss = "".join(t for r, t in mine if r == "assistant")
        assert got[conv] == (len(mine), sha("".join(f"{r}\n{t}\n" for r, t in mine)), len(loss), sha(loss))
    assert t == 0


def test_parts(spark):
    parts = [("text", "see <this>", None, None), ("image", None, "s3://a.png", None), None, ("text", None, None, None), ("audio", None, "b.wav", 12)]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, content array<{cf.PART}>")
    row = cf.format_turns(df).first()
    assert row["formatted"] == "<s>[assistant]\nsee \\<this><|image:1|><|audio:3|></s>"
    assert [tuple(a) for a in row["attachments"]] == [(1, "image", "s3://a.png", 576), (3, "audio", "b.wav", 12)]
    assert row["attachment_tokens"] == 588
    assert cf.read_turn(row["formatted"]) == ("assistant", "see <this><|image:1|><|audio:3|>")
    paper = [("document", None, "paper.pdf", None), ("text", "and", None, None), ("document", None, None, 7)]
    row = cf.format_turns(spark.createDataFrame([(1, 0, "user", paper)], df.schema)).first()
    assert row["formatted"] == "<s>[user]\n<|document:0|>and<|document:2|></s>"
    assert [tuple(a) for a in row["attachments"]] == [(0, "document", "paper.pdf", 1024), (2, "document", None, 7)]
    bad = spark.createDataFrame([(1, 0, "user", [("video", None, "x", None)])], df.schema)
    with pytest.raises(Exception, match="unknown part type"):
        cf.format_turns(bad).collect()


def test_empty(spark):
    df = spark.createDataFrame([], f"conv_id long, turn long, role string, content array<{cf.PART}>")
    assert cf.conversation_digests(cf.format_turns(df)).count() == 0


READS = r"""
import resource, sys
from claimloom.llm.chat_format import read_turn
text = {"plain": "plain words \u00e9, " * 1_300_000, "signs": "<\\[" * 6_600_000}[sys.argv[1]]
formatted = "<s>[user]\n" + text.replace("\\", "\\\\").replace("<", "\\<").replace("[", "\\[") + "</s>"
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert read_turn(formatted) == ("user", text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / len(formatted))
"""


@pytest.mark.parametrize("kind", ["plain", "signs"])
def test_reading_a_long_turn_takes_memory_in_proportion(kind):
    """20 MB and 40 MB of text, prose or control signs alone, take a few bytes a character more than they are."""
    done = subprocess.run([sys.executable, "-c", READS, kind], capture_output=True, text=True, cwd=".")
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 6, done.stdout
