"""Periodic runs of words, by an online sparse dynamic program over diagonals.

A diagonal is a lag: word i lies on it where the word q places earlier is the same. A run with
period q is a stretch of such words. Going through a text word by word, the earlier occurrences of
a word say on which diagonals it lies, and the match lengths of these grow by one; a diagonal that
ends with sufficient length is a run and is emitted at once.

Frequent words have too many earlier occurrences to look at them all, and need not: a run of 4
periods matches on 3 periods of its diagonal, so it holds 3 words in a row whose places are
multiples of the lag. A lag is therefore opened only by occurrences at such places, of which a text
of n words has n*ln(n) whatever its words are. From its third such match on, a diagonal is followed
word by word to its ends. A lag that is a multiple of the period of a run that is still open is
left alone: the run repeats with the smaller period, and would be found again at each multiple.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, small_batches

#: A run has at least this many words, and this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4

#: Words whose cells are looked at together; bounds the memory a text takes.
BLOCK = 65_536

_RUNS = "array<struct<start:long,length:long,period:long>>"
_ARROW_RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def cells(low: int, high: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from ``low`` on below ``high`` with the lags, ``lags`` at most, that divide them and
    have three multiples before or at them; by place, then lag."""
    lag = np.arange(1, min(lags, (high - 1) // 3) + 1, dtype=np.int64)
    first = np.maximum(-(-low // lag) * lag, 3 * lag)
    many = np.maximum((high - 1 - first) // lag + 1, 0)
    which = np.repeat(np.arange(len(lag)), many)
    nth = np.arange(len(which)) - (np.cumsum(many) - many)[which]
    place = first[which] + nth * lag[which]
    order = np.argsort(place, kind="stable")
    return place[order], lag[which][order]


def diagonal(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """First and end (exclusive) of the stretch about ``at`` in which words equal those before by
    ``lag``; steps double, so the cost follows the stretch."""
    first, step = at, 32
    while first > lag:
        low = max(lag, first - step)
        differ = np.flatnonzero(words[low:first] != words[low - lag : first - lag])
        if len(differ):
            first = low + int(differ[-1]) + 1
            break
        first, step = low, step * 2
    end, step, n = at + 1, 32, len(words)
    while end < n:
        high = min(n, end + step)
        differ = np.flatnonzero(words[end:high] != words[end - lag : high - lag])
        if len(differ):
            end += int(differ[0])
            break
        end, step = high, step * 2
    return first, end


def _outside(place: np.ndarray, lag: np.ndarray, run: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The cells without those that only repeat a run, given as (period, start, end)."""
    period, start, end = run
    kept = (lag % period != 0) | (place >= end) | (place - lag < start)
    return place[kept], lag[kept]


def powers(n: int) -> np.ndarray:
    """1, b, b*b, ... modulo 2**64."""
    steps = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def runs(words: np.ndarray, head: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period, of words given as numbers.

    ``head`` are the cells of the first block, for callers that have many texts. Whether the last
    2 periods of a diagonal match is asked of sums of hashes first, so that the words themselves are
    only compared where they do (or, rarely, where two sums are equal by chance).
    """
    n, found = len(words), []
    if n < LEAST_WORDS:
        return found
    measured: dict[int, int] = {}  # where the last stretch of a lag ends
    active: list[tuple[int, int, int]] = []  # (period, start, end) of runs not yet over
    power = powers(n)
    value = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power, dtype=np.uint64)])
    for low in range(0, n, BLOCK):
        high = min(n, low + BLOCK)
        place, lag = head if head and not low else cells(low, high, n // LEAST_PERIODS)
        upto = int(np.searchsorted(place, high))
        place, lag = place[:upto], lag[:upto]
        for run in active:
            place, lag = _outside(place, lag, run)
        for back in range(2):
            same = words[place - back * lag] == words[place - (back + 1) * lag]
            place, lag = place[same], lag[same]
        late = sums[place + 1] - sums[place - 2 * lag]
        same = late == (sums[place + 1 - lag] - sums[place - 3 * lag]) * power[lag]
        place, lag = place[same], lag[same]
        at = 0
        while at < len(place):
            i, q = int(place[at]), int(lag[at])
            at += 1
            if measured.get(q, 0) > i:
                continue
            active = [r for r in active if r[2] > i]
            if any(q % p == 0 and start <= i - q for p, start, _ in active):
                continue
            first, end = diagonal(words, i, q)
            if first > i - 2 * q:
                continue
            measured[q] = end
            start, length = first - q, end - first + q
            if length >= max(LEAST_WORDS, LEAST_PERIODS * q):
                active.append((q, start, end))
                found.append((start, length, q))
                if 16 * length > len(place) - at:  # a long run: pass over its cells together
                    (place, lag), at = _outside(place[at:], lag[at:], active[-1]), 0
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal for equal words."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def repeats(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed`` in place of columns of these names.

    Words are stretches without ASCII white space, numbered from 0. ``runs`` holds (start, length,
    period) by start, then period: maximal stretches of words with smallest period ``period`` and at
    least LEAST_WORDS words and LEAST_PERIODS periods. Runs may overlap. ``collapsed`` is the text
    without the words that a run contains after its first period, joined by one space.

    Null, empty and white texts have no words, no runs and an empty ``collapsed``. Rows are judged
    one by one, so null, repeated or clashing ids and repeated rows keep a row each; an empty table
    gives an empty result. A text is one row of one task: its memory follows its words.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf(f"struct<n_words:long,runs:{_RUNS},collapsed:string>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        head = cells(0, BLOCK, BLOCK)
        for texts in batches:
            sizes, all_runs, left = [], [], []
            for value in texts.cast(pa.large_binary()).to_pylist():
                words = (value or b"").split()
                found = runs(numbered(words), head)
                if found:
                    kept = np.flatnonzero(~repeats(len(words), found))
                    left.append(b" ".join([words[i] for i in kept]))
                else:
                    left.append(b" ".join(words))
                sizes.append(len(words))
                all_runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
            yield pa.StructArray.from_arrays(
                [
                    pa.array(sizes, pa.int64()),
                    pa.array(all_runs, pa.list_(_ARROW_RUN)),
                    pa.array(left, pa.binary()).cast(pa.string()),
                ],
                names=["n_words", "runs", "collapsed"],
            )

    found = fresh(docs, "found")
    own = ("n_words", "runs", "collapsed")
    kept = [c for c in docs.columns if c.lower() not in own]
    return docs.withColumn(found, scanned(F.col(text))).select(*kept, *[F.col(found)[c].alias(c) for c in own])


def strongest(found: Column) -> Column:
    """The run with the most periods, compared exactly; of ties the first, null where there is none."""
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(found, nothing, better)


def listed(found: Column) -> Column:
    """Runs as start,length,period, each with a line feed."""
    return F.array_join(
        F.transform(
            found,
            lambda r: F.concat(
                F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")
            ),
        ),
        "",
    )


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where a tenth of the texts, by a hash of the id, repeat a stretch of their words.

    Of such a text the words from place a on are the first p of them over and over. Other texts stay as
    they are, and so do texts without words and rows without an id.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    bare = F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    stretch = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(stretch, F.lit(1), n - a)), " ")
    return docs.withColumn(text, F.when((h % 10 == 0) & (bare != ""), planted).otherwise(F.col(text)))
