"""Debounced sweeps over several micro-batches, against a plain walk through time."""

import datetime as dt
import json
import os
import random

import pytest

from claimloom.streaming import events as V
from claimloom.streaming import timers as T

HOUR = 3_600_000
SCHEMA = "project string, at timestamp, pending long, stamp timestamp"


def at(hours):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hours)


def plain(rows, until, interval=24, cap=10):
    """Sweeps of one project by walking through the minutes: ``rows`` are (hour, pending, stamp hour)."""
    out, last, left = [], None, 0
    by_minute = {}
    for hour, pending, stamp in rows:
        by_minute.setdefault(round(hour * 60), []).append((pending, stamp))

    def sweep(minute, n, cause):
        nonlocal last, left
        done = min(n, cap)
        left = n - done
        last = minute - interval * 30 if left else minute
        out.append((minute / 60, done, left, cause))

    for minute in range(0, round(until * 60) + 1):
        if left and minute - last >= interval * 60:
            sweep(minute, left, "timer")
        for pending, stamp in sorted(by_minute.get(minute, []), key=lambda r: (r[1] is not None, r[1] or 0, r[0] or 0)):
            if stamp is not None:
                if stamp * 60 <= minute and not left and (last is None or stamp * 60 > last or minute - last >= interval * 60):
                    last = stamp * 60
            elif last is None or minute - last >= interval * 60:
                sweep(minute, pending or 0, "activity")
            elif left and pending:
                left = pending
    return out


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(T.STORE[0])
    spark.conf.set(*T.STORE)
    yield spark
    spark.conf.set(T.STORE[0], before)


def streamed(spark, folder, batches):
    """Each batch is a file, and a file is a micro-batch."""
    folder.mkdir()
    for i, rows in enumerate(batches):
        lines = [json.dumps({"project": p, "at": at(h).isoformat() if h is not None else None, "pending": n, "stamp": at(s).isoformat() if s is not None else None}) for p, h, n, s in rows]
        (folder / f"{i}.jsonl").write_text("\n".join(lines) + "\n")
        os.utime(folder / f"{i}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    got = V.run_to_table(T.debounced_sweeps(rows, cap=10), "sweeps-test").collect()
    return sorted((r["project"], round((r["at"].replace(tzinfo=dt.timezone.utc) - at(0)).total_seconds() / 3600, 4), r["archived"], r["overflow"], r["cause"]) for r in got)


def test_bursts_stamps_and_leftovers(rocks, tmp_path):
    batches = [
        [("burst", 1.0, 3, None), ("burst", 1.1, 4, None), ("burst", 1.2, 5, None), ("over", 1.0, 25, None), (None, 2.0, None, None)],
        [("burst", 20.0, 5, None), ("future", 3.0, None, 90.0), ("future", 4.0, 2, None), ("past", 3.0, None, 2.0), ("past", 4.0, 2, None), (None, None, 9, None)],
        [("burst", 25.5, 6, None), ("past", 26.5, 7, None)],
        [("clock", 120.0, 0, None)],
        [("clock", 240.0, 0, None)],
    ]
    assert streamed(rocks, tmp_path / "in", batches) == sorted([
        ("burst", 1.0, 3, 0, "activity"), ("burst", 25.5, 6, 0, "activity"),
        ("over", 1.0, 10, 15, "activity"), ("over", 13.0, 10, 5, "timer"), ("over", 25.0, 5, 0, "timer"),
        ("", 2.0, 0, 0, "activity"), ("future", 4.0, 2, 0, "activity"), ("past", 26.5, 7, 0, "activity"),
        ("clock", 120.0, 0, 0, "activity"), ("clock", 240.0, 0, 0, "activity"),
    ])


def test_any_cut_equals_a_plain_walk(rocks, tmp_path):
    r = random.Random(6)
    rows = []
    for p in ("a", "b", "c", "d"):
        for _ in range(14):
            hour = r.randint(0, 24 * 60 * 5) / 60
            stamp = r.choice([None] * 5 + [hour - 1, hour - 30, hour + 5])
            rows.append((p, hour, None if stamp is not None else r.choice([0, 3, 12, 35]), stamp))
    rows.sort(key=lambda x: x[1])
    cuts = sorted(r.sample(range(1, len(rows)), 4))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])] + [[("clock", 400.0, 0, None)], [("clock", 800.0, 0, None)]]
    want = [("clock", 400.0, 0, 0, "activity"), ("clock", 800.0, 0, 0, "activity")]
    for p in ("a", "b", "c", "d"):
        want += [(p, round(h, 4), n, left, cause) for h, n, left, cause in plain([x[1:] for x in rows if x[0] == p], 799)]
    assert streamed(rocks, tmp_path / "in", batches) == sorted(want)
