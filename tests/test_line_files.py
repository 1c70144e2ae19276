"""Files that grow and files read from their ends."""

import io
import random

import pytest

from claimloom.plans.staging import new_path
from claimloom.sources import line_files as L
from claimloom.streaming import events as V


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    def __init__(self, data):
        super().__init__(data)
        self.taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def plain_tail(data, most):
    start = max(0, len(data) - most)
    lines = data[start:].split(b"\n")
    if start:
        lines = lines[1:]
    return lines[:-1] if lines and not lines[-1] else lines


@pytest.mark.parametrize("ends", [b"\n", b""])
def test_the_end_of_files_below_at_and_above_the_range(ends):
    lines = [b"x" * n for n in (3, 0, 10, 7, 1, 22, 5)]
    data = b"\n".join(lines) + ends
    for most in range(1, len(data) + 3):
        file = Counted(data)
        got = L.lines_at_end(file, len(data), most)
        assert [line for _, line in got] == plain_tail(data, most), most
        assert all(data[at : at + len(line)] == line and (at == 0 or data[at - 1 : at] == b"\n") for at, line in got)
        assert file.taken == min(most, len(data))
    assert L.lines_at_end(io.BytesIO(b"abc"), 3, 2) == [] and L.lines_at_end(io.BytesIO(b"abc"), 3, 2, lone=True) == [(1, b"bc")]
    assert L.lines_at_end(io.BytesIO(b""), 0, 5) == []


def test_any_cut_of_a_file_gives_each_line_once(monkeypatch):
    monkeypatch.setattr(L, "STEP", 4)
    r = random.Random(2)
    for _ in range(200):
        data = b"".join(b"y" * r.choice([0, 1, 3, 30]) + b"\n" for _ in range(r.randint(0, 12))) + b"half"[: r.randint(0, 4)]
        cuts = sorted(r.randint(0, len(data)) for _ in range(r.randint(0, 5)))
        edges = [0, *cuts, len(data)]
        got = [x for a, b in zip(edges, edges[1:]) for x in L.lines_between(io.BytesIO(data), a, b)]
        assert [line for _, line in got] == data.split(b"\n")[:-1] and all(data[at : at + len(line)] == line for at, line in got)


def test_reads_from_the_end(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.jsonl").write_bytes(b"".join(b'{"n": %d}\n' % i for i in range(1000)) + "half \xff".encode("latin-1"))
    (tmp_path / "in" / "deep" / "b.jsonl").write_bytes(b"one\ntwo\n\n\n")
    (tmp_path / "in" / "empty.jsonl").write_bytes(b"")
    (tmp_path / "in" / "_hidden.jsonl").write_bytes(b"no\n")
    (tmp_path / "in" / "c.txt").write_bytes(b"no\n")
    got = {(r["path"].rsplit("/", 1)[1], r["value"]) for r in L.last_bytes(spark, f"file://{tmp_path}/in", most=38, suffix=".jsonl").collect()}
    assert got == {("a.jsonl", '{"n": 998}'), ("a.jsonl", '{"n": 999}'), ("a.jsonl", "half \N{REPLACEMENT CHARACTER}"), ("b.jsonl", "one"), ("b.jsonl", "two"), ("b.jsonl", "")}
    last = L.last_lines(spark, f"{tmp_path}/in", 2, suffix=".jsonl").orderBy("path", "at").collect()
    assert [r["value"] for r in last] == ['{"n": 999}', "half \N{REPLACEMENT CHARACTER}", "one", "two"]
    assert L.last_bytes(spark, f"{tmp_path}/nowhere").count() == 0


def run(spark, where, out, progress):
    lines = L.appended_lines(spark, where, ".jsonl", stretch=16)
    query = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r["path"].rsplit("/", 1)[1], r["at"], r["value"]) for r in spark.read.schema(L.LINES).parquet(out).collect())


def test_appended_lines_arrive_once_also_after_a_restart(spark, tmp_path):
    """Each call is a restart from the checkpoint: what was there is not read again, and a half-written line waits for its end."""
    (tmp_path / "in").mkdir()
    where, out, progress = f"file://{tmp_path}/in", new_path(spark, "lines"), new_path(spark, "lines-progress")
    a, b = tmp_path / "in" / "a.jsonl", tmp_path / "in" / "b.jsonl"
    a.write_text("first\nsecond line that is longer than a stretch\nha")
    want = [("a.jsonl", 0, "first"), ("a.jsonl", 6, "second line that is longer than a stretch")]
    assert run(spark, where, out, progress) == want
    assert run(spark, where, out, progress) == want
    with a.open("a") as f:
        f.write("lf\n\nthird\n")
    b.write_text("é\n")
    at = len("first\nsecond line that is longer than a stretch\n")
    want += [("a.jsonl", at, "half"), ("a.jsonl", at + 5, ""), ("a.jsonl", at + 6, "third"), ("b.jsonl", 0, "é")]
    assert run(spark, where, out, progress) == want
    # a shorter file under the same name is a new one
    b.write_text("n\n")
    assert run(spark, where, out, progress) == sorted([*want, ("b.jsonl", 0, "n")])


def test_objects_of_growing_files(spark, tmp_path):
    """Lines that aren't JSON objects go, arrays and numbers too."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.jsonl").write_text('{"kind": "a", "n": 1}\n[1]\n7\nnull\n"x"\n{bad\n\n {"kind": "b"}\n')
    stream = V.objects(L.appended_lines(spark, str(tmp_path / "in")), "kind string, n long")
    assert sorted((r["kind"], r["n"]) for r in V.run_to_table(stream, "objects").collect()) == [("a", 1), ("b", None)]
