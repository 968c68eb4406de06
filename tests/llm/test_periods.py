"""Periodic runs against all lags tried one by one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import periods
from tidemark.llm.queries import op11_periodic_runs

SCHEMA = "doc_id long, text string, runs int, found string"


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            part = w[start:i]
            smaller = any(all(part[k] == part[k - p] for k in range(p, len(part))) for p in range(1, q))
            if len(part) >= max(6, 4 * q) and not smaller:
                out.append((start, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id: int | None, text: str | None, plant: bool = True) -> tuple:
    """What the query should give for a document, from the rules as they are worded."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if plant and h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in found)]
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    milli = 1000 * best[1] // best[2] if found else None
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, " ".join(kept))]
    return (doc_id, len(found), *best, milli, *digests)


def repeating(rng: random.Random) -> list[int]:
    letters = rng.choice([1, 2, 2, 3, 6])
    w = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 4)):
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
        at = rng.randint(0, len(w))
        w[at:at] = unit * rng.randint(2, 7) + unit[: rng.randint(0, len(unit))]
    return w


@pytest.mark.parametrize("block", [periods.BLOCK, 48])
def test_runs_equal_all_lags(monkeypatch, block):
    monkeypatch.setattr(periods, "BLOCK", block)
    head = periods.cells(0, block, block)
    rng = random.Random(block)
    for _ in range(800):
        w = repeating(rng)
        got = periods.runs(np.array(w, np.int32), head)
        assert got == plain_runs(w), w


def test_named_runs():
    def of(text: str) -> list:
        return periods.runs(periods.numbered(text.encode().split()))

    assert of("a a a a a") == []
    assert of("a a a a a a") == [(0, 6, 1)]
    assert of("x a b a b a b a b y") == [(1, 8, 2)]
    assert of("a b a b a b a") == []
    assert of("a a a a a a b b b b b b") == [(0, 6, 1), (6, 6, 1)]
    # A run inside a run: six equal words in each of four periods.
    assert of("a a a a a a b " * 4) == [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]


@pytest.mark.parametrize(
    "words",
    [
        np.zeros(300_000, np.int32),
        np.tile(np.array([0] * 99 + [1], np.int32), 3_000),
        np.arange(300_000, dtype=np.int32) % 70_000,
    ],
    ids=["one word", "nearly one word", "long period"],
)
def test_long_texts(words):
    found = periods.runs(words)
    period = {1: 1, 2: 100, 70_000: 70_000}[len(np.unique(words))]
    assert (0, len(words), period) in found
    assert all((s + m == len(words) or words[s + m] != words[s + m - q]) and m >= 4 * q for s, m, q in found)


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    texts = [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "one",
        "ho ho ho ho ho ho",
        "\x0b la  la\tla\nla\rla\x0cla ",
        "la la la la la la la la la la la la",
        "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb",
        "é ç é ç é ç é ç",
        "word " * 30_000,
    ]
    texts += [" ".join(f"w{x}" for x in repeating(rng)) for _ in range(150)]
    rows = [(i, t, i, "f") for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], (None, "no id " * 9, 1, None), (None, "no id " * 9, 1, None)]


def test_operator_on_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    got = periods.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "found", "n_words", "runs", "collapsed"]
    want = []
    for doc_id, text, _, _ in odd_rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = plain_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in found)]
        want.append((doc_id, len(w), found, " ".join(kept)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    rows = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()]
    assert sorted(rows, key=key) == sorted(want, key=key)
    empty = spark.createDataFrame([], SCHEMA)
    assert periods.periodic_runs(periods.with_planted_runs(empty)).count() == 0


def test_query_on_planted_rows(spark, tmp_path):
    rows = [r[:2] for r in odd_rows() if r[1] is None or len(r[1]) < 10_000]
    rng = random.Random(8)
    rows += [(1000 + i, " ".join(f"v{rng.randrange(50)}" for _ in range(rng.randint(1, 90)))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    want = [plain_row(*r) for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in got) > 30


def test_equally_strong_runs_take_the_first(spark):
    text = " ".join(["x", *"aaaaaa", "y", *"bbbbbb", "z", *("c d " * 6).split()])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    best = periods.periodic_runs(docs).select(periods.strongest("runs").alias("b")).first().b
    assert tuple(best) == (1, 6, 1)
