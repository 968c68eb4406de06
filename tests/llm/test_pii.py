"""Personal data against the patterns as they are worded, and disguises made from plain identifiers."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest

from tidemark.llm import pii
from tidemark.llm.queries import op12_personal_data

SCHEMA = "doc_id long, text string, spans string, kind int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text: str | None) -> list[tuple[int, int, int]]:
    return sorted(
        (m.start(), no, m.end())
        for no, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if passes(kind, m[0])
    )


@pytest.fixture(scope="module")
def transducers():
    return pii.Transducers()


@pytest.mark.parametrize("alphabet", ["a.@-_", "0123456789. ", "012 -+().", "a1@. +-(", "é٣a@1."])
def test_identifiers_equal_the_patterns(alphabet):
    rng = random.Random(alphabet)
    found = 0
    for _ in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert pii.identifiers(text) == plain(text), text
        found += len(plain(text))
    assert found


def cards_and_phones() -> list[str]:
    return ["4041894974608795", "4041 8949 7460 8795", "4041-8949-7460-8795", "+1 (988) 555-2485", "+49 30 1234567"]


def test_numbers_at_their_bounds():
    for text in cards_and_phones():
        assert pii.identifiers(text) == plain(text) != []
    for text in ("1.2.3.256", "+1 234567", "+1234567890123456", "4041894974608796", "0" * 20, "300.1.1.1", "1.2.3"):
        assert pii.identifiers(text) == plain(text) == []
    assert pii.identifiers("0001.02.3.000000255") == plain("0001.02.3.000000255") != []


EMAIL, IP, CARD, PHONE = ("disguised_" + k for k in ("email", "ip", "card", "phone"))


@pytest.mark.parametrize(
    ("kind", "disguise"),
    [
        (EMAIL, "jоhn.smith@exаmple.cоm"),
        (EMAIL, "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        (EMAIL, "jo​hn@exam­ple.com"),
        (EMAIL, "john dot smith at example dot co dot uk"),
        (EMAIL, "john [at] example [dot] com"),
        (EMAIL, "jane(at)mail.example.org"),
        (EMAIL, "jane {AT} mail <dot> example (.) org"),
        (EMAIL, "john@example dot com"),
        (EMAIL, "bosbt.42 at mail8.example.com"),
        (EMAIL, "john-at-example-dot-com"),
        (EMAIL, "john_at_example_dot_com"),
        (EMAIL, "john @ example . com"),
        (IP, "192[.]168[.]1[.]1"),
        (IP, "one nine two dot one six eight dot one dot one"),
        (IP, "１０.０.０.１"),
        (CARD, "4O41 8949 7460 8795"),
        (CARD, "٤٠٤١٨٩٤٩٧٤٦٠٨٧٩٥"),
        (CARD, "four zero four one 8949 seven four six zero 8795"),
        (CARD, "4041–8949–7460–8795"),
        (PHONE, "plus one nine eight eight triple five two four eight five"),
        (PHONE, "+1 (988) 555‑2485"),
        (PHONE, "+ vier neun drei null eins zwei drei vier fünf sechs"),
    ],
)
def test_disguises(transducers, kind, disguise):
    """The span in the source is the disguise, no more and no less, wherever it stands."""
    for before, after in (("", ""), ("Write é to ", " or not"), ("x: ", ".\nNext"), ("first, ", "; then")):
        text = before + disguise + after
        got = [(pii.NAMES[k], text[s:e]) for s, k, e in pii.disguised(text, transducers)]
        assert got == [(kind, disguise)], text


def test_a_disguise_inside_a_plain_identifier_keeps_both(transducers):
    text = "jоhn@example.com"  # the second letter is Cyrillic
    spans = [(pii.NAMES[k], text[s:e]) for s, k, e in pii.identifiers(text) + pii.disguised(text, transducers)]
    assert spans == [("email", "hn@example.com"), (EMAIL, text)]


@pytest.mark.parametrize(
    "text",
    [
        "Meet us at example.com tomorrow.",
        "She stared at the dot on the wall, printed at the dot matrix.",
        "Un. Un. Un. Un. Un, un un un, uno dos tres.",
        "one two three four",
        "Привет, мир. Это 12 рублей @ работа",
        "naïve café – déjà vu (at home) [at work] 3·4·5·6",
        "two at one, six at seven; at at at. dot dot dot",
        "f(at) = x[dot] - a.b.c.d",
        "mail john.smith@example.com or +1 (988) 555-2485, 10.0.0.1",
    ],
)
def test_clean_texts_have_no_disguises(transducers, text):
    assert pii.disguised(text, transducers) == []


def test_rewriting_keeps_sources():
    rng = random.Random(3)
    for _ in range(300):
        source = "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 40)))
        t, want = pii.Rewritten.of(source), [(c, i, i + 1) for i, c in enumerate(source)]
        for _ in range(3):
            edits, at = [], 0
            while at < len(t.text):
                size = rng.randint(1, 4)
                if rng.random() < 0.3 and at + size <= len(t.text):
                    edits.append((at, at + size, "XYZ"[: rng.randint(0, 3)]))
                at += size
            if not edits:
                continue
            for start, end, new in reversed(edits):
                want[start:end] = [(c, want[start][1], want[end - 1][2]) for c in new]
            t = t.edited(edits)
            assert list(zip(t.text, t.begin.tolist(), t.end.tolist())) == want


def test_long_texts_take_linear_time(transducers):
    for unit in (" ", "x", "1", "1 ", "a dot ", " at", "( ", "un ", "+ ", "1.", "-at-", "a@", "о", "@ ", "one ", "dot "):
        text = unit * (400_000 // len(unit)) + "x"
        began = time.time()
        pii.identifiers(text)
        pii.disguised(text, transducers)
        assert time.time() - began < 10, unit


def rows() -> list[tuple]:
    texts = [
        None,
        "",
        " \n",
        "no data",
        "a@b.c a@b.c@d.e +1 (988) 555-2485 4041 8949 7460 8795 1.2.3.4.5.6.7.8 999.1.1.1",
        "中文 😀 x@y.z 😀 jоhn@example.com",
        "word " * 30_000 + "x@y.z",
        "john at example dot com, " * 200,
    ]
    made = [(i, t, "s", i) for i, t in enumerate(texts)]
    return made + [made[4], made[4], (None, "x@y.z", None, 1), (None, "x@y.z", None, 1)]


def test_query_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(rows())
    texts = {r[0]: r[1] for r in rows()}
    for r in got:
        base = plain(texts[r.doc_id])
        kinds = [list(PATTERNS)[k] for _, k, _ in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in PATTERNS]
        said = ",".join(f"{k}:{s}:{e}" for k, (s, _, e) in zip(kinds, base))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert ",".join(s for s in spans if not s.startswith("disguised_")) == said
        if r.doc_id == 7:
            assert spans == [f"{EMAIL}:{25 * i}:{25 * i + 23}" for i in range(200)]
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find_personal_data(empty).count() == 0
    assert pii.find_personal_data(docs).columns == ["doc_id", "spans"]
