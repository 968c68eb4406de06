"""Long candidates of the secret scan and large ids of the weighted samples."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import secrets, weighted_sampling

WORD = r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
MARKED = r"[A-Za-z0-9+]*(?i:abcdefgh|01234567|example|placeholder|x{6,})[A-Za-z0-9+]*"
#: What the allow-list says, without care for how long it takes.
PLAIN = (
    r"^[^0-9]+$",
    r"^[0-9]+$",
    r"^[0-9a-f]{24,}$",
    rf"^(?:{WORD})(?:[-_/]+(?:{WORD}))+$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    rf"^[-_/]*(?:{MARKED}|{WORD})(?:[-_/]+(?:{MARKED}|{WORD}))*[-_/]*$",
)


def candidates(rng: random.Random, n: int) -> list[str]:
    pieces = ["ab", "Abc", "ABC", "ABc", "12", "a1", "1a", "+", "example", "xxxxxx", "xxxxxxx1", "01234567", "a+b", "-", "_", "/", "-_", "f00d", "Ex"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_allow_list_says_the_same():
    for text in candidates(random.Random(1), 20_000):
        for plain, fast in zip(PLAIN, secrets.ALLOWED):
            assert bool(re.search(plain, text)) == bool(re.search(fast, text)), (plain, text)


LONG = {
    "segments": "-".join(["ab", "12"] * 170_000),
    "one run": "x" * 1_000_000 + "1-a1B2",
    "uuids": "-".join(["123e4567-e89b-12d3-a456-426614174000"] * 27_000),
    "base64": "".join(random.Random(2).choice("abcXYZ019+/") for _ in range(1_000_000)),
    "digits": "1" * 1_000_000 + "a",
    "marks": "example-" * 125_000 + "a1B2",
    "separators": "-_/" * 330_000 + "1a",
}


@pytest.mark.parametrize("shape", sorted(LONG))
def test_allow_list_on_a_megabyte(spark, shape):
    frame = spark.createDataFrame([(LONG[shape],)], "value string").cache()
    frame.count()
    began = time.time()
    frame.select(*[F.col("value").rlike(p).alias(f"p{i}") for i, p in enumerate(secrets.ALLOWED)]).collect()
    assert time.time() - began < 5


def test_long_candidates_are_scanned(spark):
    rows = [(i, text[:50_000] + " password=hunter22") for i, text in enumerate(LONG.values())]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert all("assign" in {s.kind for s in r.spans} for r in found)


def test_ids_beyond_2_53_beside_a_null(spark):
    rng = random.Random(3)
    rows = [(2**60 + i, f"text {i} " + " ".join(rng.choice("abcdefg") for _ in range(10))) for i in range(400)]
    rows.append((None, "no id a b c"))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in weighted_sampling.fingerprints(frame).collect()}
    assert len(got) == len(rows)
    order = sorted(rows[:-1], reverse=True) + [rows[-1]]
    for (ident, text), (_, following) in zip(order, order[1:] + order[:1]):
        assert got[ident].edited_text == weighted_sampling.edited(text, following)


def test_words_met_before_are_not_hashed_again(monkeypatch):
    """Of words that stand once, the sample takes the hash kept with their draws."""
    draws = weighted_sampling.Draws()
    counts = weighted_sampling.bag("one two three four five six")
    first = weighted_sampling.sample(counts, draws)
    plain, calls = weighted_sampling.xxhash.xxh64_intdigest, []
    monkeypatch.setattr(weighted_sampling.xxhash, "xxh64_intdigest", lambda *a: calls.append(a) or plain(*a))
    again = weighted_sampling.sample(counts, draws)
    assert not calls
    assert again.tolist() == first.tolist()
    assert set(first.tolist()) <= {plain(w, 0) & 0xFFFF for w in counts}
