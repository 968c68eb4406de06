"""Whitening against numpy over all distinct vectors at once."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.queries import op13_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int, key string"


def entries(vector) -> tuple | None:
    if not vector or any(e is None or not math.isfinite(e) for e in vector):
        return None
    return tuple(math.floor(256 * float(np.float32(e))) for e in vector)


def plain(rows: list[tuple], components: int = 4, by_count: bool = False) -> dict:
    """By the distinct vector: what its rows should carry (signs left open)."""
    held = [entries(r[1]) for r in rows]
    held = [x for x in held if x]
    fit_list = held if by_count else list(dict.fromkeys(held))
    x = np.array(fit_list, object)
    n, s = len(fit_list), x.sum(axis=0)
    apart = (x * n - s).astype(float) / n
    v = apart.T @ apart / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    out = {}
    for i, key in enumerate(fit_list):
        deviation = int(((x[i] * n - s) ** 2).sum())
        white = [abs(apart[i] @ vectors[:, c]) / math.sqrt(values[c]) for c in order]
        out[key] = (n, deviation, white, [values[c] / values.sum() for c in order])
    return out


def table(rng: random.Random, rows: int, dims: int) -> list[tuple]:
    """Vectors of which one has a third of all rows, with odd ones among them."""
    hot = [rng.gauss(0, 1) for _ in range(dims)]
    made = []
    for i in range(rows):
        vector = hot if i % 3 == 0 else [rng.gauss(0, 1 + d) for d in range(dims)]
        made.append((i, vector, "x", i, "k"))
    made += [
        (900, None, "x", 1, None),
        (901, [], "x", 1, None),
        (902, [1.0] * (dims - 1) + [None], "x", 1, None),
        (903, [float("nan")] * dims, "x", 1, None),
        (904, [float("inf")] + [0.0] * (dims - 1), "x", 1, None),
        (905, [-0.0] * dims, "x", 1, None),
        (906, [0.0] * dims, "x", 1, None),
        (None, made[1][1], None, None, None),
        (None, made[1][1], None, None, None),
        made[2],
    ]
    return made


@pytest.mark.parametrize("by_count", [False, True])
def test_figures_equal_numpy(spark, monkeypatch, by_count):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    rows = table(random.Random(2), 120, 6)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), by_count=by_count).collect()
    want = plain(rows, by_count=by_count)
    kept = [r for r in rows if entries(r[1])]
    assert len(got) == 4 * len(kept)
    ids = [r[0] for r in kept]
    assert sorted(r.vec_id is None for r in got) == sorted(i is None for i in ids for _ in range(4))
    vectors = {r[0]: entries(r[1]) for r in kept}
    signs = {}
    for r in got:
        n, deviation, white, explained = want[vectors[r.vec_id]]
        c = r.component - 1
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - white[c]) < 1e-9
        assert abs(r.explained - explained[c]) < 1e-9 * explained[c]
        assert r.identity_error < 1e-9
        signs.setdefault((vectors[r.vec_id], c), set()).add(r.whitened)
    assert all(len(s) == 1 for s in signs.values())
    # The whitened vectors themselves, signs and all, have covariance one.
    y = np.array([[next(iter(signs[k, c])) for c in range(4)] for k in want])
    weight = [sum(v == k for v in map(entries, (r[1] for r in rows))) if by_count else 1 for k in want]
    assert np.allclose(np.cov(y.T, bias=True, fweights=weight), np.eye(4), atol=1e-9)


def test_few_vectors_and_dimensions(spark):
    def of(vectors: list) -> list:
        return whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id int, embedding array<double>")).collect()

    assert of([]) == [] == of([None, [None], []])
    alone = of([[1.0, 2.0]] * 3)
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone if r.vec_id == 0] == [
        (c, 1, 0, None, None, None) for c in (1, 2)
    ]
    line = of([[float(i), 2.0 * i, 0.0] for i in range(5)])
    first = [r.whitened for r in line if r.component == 1]
    assert np.isclose(np.var(first), 1) and all(r.whitened is None and r.explained == 0 for r in line if r.component > 1)
    assert line[0].identity_error < 1e-9
    mixed = of([[1.0, 2.0], [2.0, 1.0], [0.0, 0.0], [1.0], [1.0, 2.0, 3.0]])
    assert sorted((r.vec_id, r.n) for r in mixed if r.component == 1) == [(0, 3), (1, 3), (2, 3), (3, None), (4, None)]


def test_large_entries_stay_exact(spark):
    vectors = [[1e300, 0.0], [-1e300, 1.0], [3.0, 2.5e6]]
    rows = [(i, v) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    cut = [[max(-(2**31), min(2**31, math.floor(e * 256) if abs(e) < 1e9 else int(math.copysign(2**31, e)))) for e in v] for v in vectors]
    n, s = 3, [sum(c) for c in zip(*cut)]
    want = [sum((n * e - t) ** 2 for e, t in zip(v, s)) for v in cut]
    assert {r.vec_id: r.deviation for r in got} == {i: w if w < 2**63 else None for i, w in enumerate(want)}
    assert any(w >= 2**63 for w in want)


def test_query_on_the_delivered_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = plain(rows)
    by_id = {i: entries(v) for i, v in rows}
    got = op13_embedding_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 4 * len(rows)
    for r in got:
        n, deviation, white, explained = want[by_id[r.vec_id]]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - white[r.component - 1]) < 1e-8
        assert abs(r.explained - explained[r.component - 1]) < 1e-10
        assert r.identity_error < 1e-9
