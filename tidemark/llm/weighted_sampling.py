"""Document fingerprints by consistent weighted sampling.

A document is a bag of words weighted by their counts. For each of K samples every word draws, by
the hash of word and sample, r and c from Gamma(2, 1) and b from the unit interval. With weight w
it takes t = floor(ln w / r + b), y = exp(r (t - b)) and a = c / (y exp(r)); the word with the
smallest a, with its t, is the sample. Two documents agree in a sample with a probability equal to
their generalised Jaccard similarity, the sum of the smaller over the sum of the larger weights.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches

SAMPLES = 128
#: Words whose draws a task remembers: twice as many at weight 1, and with all their numbers.
LIGHT_WORDS, HEAVY_WORDS = 60_000, 5_000
_CHUNK = 32
#: Ranges of ids that the table is dealt into for each shuffle partition.
RANGES = 8


class _Remembered:
    """Rows of numbers made from the hashes of words, each kept while its word keeps coming up:
    when a generation of ``most`` words is full, it becomes the old one, from which words that
    come up again move over."""

    def __init__(self, make, width: int, most: int):
        self.make, self.most = make, most
        self.rows: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.table = np.empty((most, width), dtype=np.float32)
        self.old_table = np.empty((most, width), dtype=np.float32)
        # The last 16 bits of the words' hashes.
        self.codes, self.old_codes = np.empty(most, dtype="<u2"), np.empty(most, dtype="<u2")

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One row and one code a word; at most ``most`` words at a time."""
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > self.most:
            self.rows, self.old = {}, self.rows
            self.table, self.old_table = self.old_table, self.table
            self.codes, self.old_codes = self.old_codes, self.codes
            new = words
        moved = [w for w in new if w in self.old]
        made = [w for w in new if w not in self.old]
        at = len(self.rows)
        if moved:
            places = [self.old[w] for w in moved]
            self.table[at : at + len(moved)] = self.old_table[places]
            self.codes[at : at + len(moved)] = self.old_codes[places]
            at += len(moved)
        if made:
            hashes = _hashes(made)
            self.make(hashes, self.table[at : at + len(made)])
            self.codes[at : at + len(made)] = hashes & np.uint64(0xFFFF)
        self.rows.update(zip(moved + made, range(len(self.rows), len(self.rows) + len(new))))
        places = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        return self.table.take(places, axis=0), self.codes[places]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Draws:
    """The numbers that words draw for each sample.

    A Gamma(2, 1) number r and a b from the unit interval are the same as two exponential numbers
    d = r (1 - b) and e = r b. At weight 1, where t is 0, a is c / exp(d), so e isn't needed there.
    """

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        odd = np.random.default_rng(9).integers(0, 2**31, (3, 4 * samples), dtype=np.uint32)
        self.factors = odd * np.uint32(2) + np.uint32(1)
        self.light = _Remembered(self._at_weight_1, samples, LIGHT_WORDS)
        self.heavy = _Remembered(self._all, 3 * samples, HEAVY_WORDS)

    def _uniform(self, hashes: np.ndarray, parts: int) -> np.ndarray:
        """The first ``parts`` numbers between 0 and 1 for each hash and sample, side by side."""
        low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]
        high = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
        a, b, c = self.factors[:, : parts * self.samples]
        # 32-bit products wrap; the end is the finaliser of MurmurHash3.
        x = low * a
        x += high * b
        x += c
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        # 24 bits of the last step, so that a number never rounds to 1.
        x ^= x >> np.uint32(16)
        x >>= np.uint32(8)
        u = x.astype(np.float32)
        u += np.float32(0.5)
        u *= np.float32(2.0**-24)
        return u

    def _at_weight_1(self, hashes: np.ndarray, into: np.ndarray) -> None:
        """a at weight 1: c times the first number, which is exp(-d)."""
        n = self.samples
        for k in range(0, len(hashes), _CHUNK):
            u = self._uniform(hashes[k : k + _CHUNK], 3)
            into[k : k + _CHUNK] = -np.log(u[:, n : 2 * n] * u[:, 2 * n :]) * u[:, :n]

    def _all(self, hashes: np.ndarray, into: np.ndarray) -> None:
        """r, b and c."""
        n = self.samples
        for k in range(0, len(hashes), _CHUNK):
            u = self._uniform(hashes[k : k + _CHUNK], 4)
            d, e = -np.log(u[:, :n]), -np.log(u[:, 3 * n :])
            c = -np.log(u[:, n : 2 * n] * u[:, 2 * n : 3 * n])
            into[k : k + _CHUNK] = np.concatenate((d + e, e / (d + e), c), axis=1)


def bag(text: str) -> Counter[bytes]:
    """Counts of the words between ASCII white space, A to Z in lower case."""
    return Counter(text.encode("utf-8", "surrogatepass").lower().split())


def sample(counts: Counter[bytes], draws: Draws) -> np.ndarray:
    """The samples of a bag as 16-bit numbers; an empty bag gives zeros."""
    n = draws.samples
    best, chosen = np.full(n, np.inf, dtype=np.float32), np.zeros(n, dtype="<u2")
    # Repeated words first, then the others.
    heavy = [w for w, k in counts.items() if k > 1]
    owners: list[tuple[bytes, int] | None] = [None] * n
    for at in range(0, len(heavy), HEAVY_WORDS):
        words = heavy[at : at + HEAVY_WORDS]
        drawn, _ = draws.heavy.of(words)
        r, b, c = drawn[:, :n], drawn[:, n : 2 * n], drawn[:, 2 * n :]
        logs = np.log(np.fromiter(map(counts.__getitem__, words), np.float32, len(words)))
        t = np.floor(logs[:, None] / r + b)
        better, low = _lower(best, c * np.exp(-r * (t - b + 1)))
        for k, i, step in zip(better.tolist(), low.tolist(), t[low, better].tolist()):
            owners[k] = words[i], int(step)
    light = list(counts) if not heavy else [w for w, k in counts.items() if k == 1]
    of_heavy = np.ones(n, bool)
    for at in range(0, len(light), LIGHT_WORDS):
        a, codes = draws.light.of(light[at : at + LIGHT_WORDS])
        better, low = _lower(best, a)
        # At weight 1 t is 0, and a word's hash with it is the hash it draws by.
        chosen[better] = codes[low]
        of_heavy[better] = False
    if heavy:
        for k in np.flatnonzero(of_heavy).tolist():
            if owners[k]:
                chosen[k] = xxhash.xxh64_intdigest(*owners[k]) & 0xFFFF
    return chosen


def _lower(best: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowers ``best`` to the smallest of each column of ``a``: the columns where it did, and the first row
    that holds the smallest."""
    least = a.min(axis=0)
    better = np.flatnonzero(least < best)
    # Row by row, so of equal numbers the first row is written last.
    rows, columns = np.divmod(np.flatnonzero(a == least), a.shape[1])
    low = np.zeros(a.shape[1], np.int64)
    low[columns[::-1]] = rows[::-1]
    best[better] = least[better]
    return better, low[better]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples, the estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _order(ident, tie) -> tuple:
    """Ascending key of the descending order by id, nulls last, then ascending tie."""
    return (ident is not None, 0 if ident is None else ident, -tie)


def _dealt(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` (id, text, tie) by descending id in ``ranges`` ranges at most: range, guest and the
    columns of ``docs``. Each range ends with a guest, the first row of the next one.

    The ranges are found on ids and ties alone; the driver gets the first id and tie of each.
    """
    keys = [F.col("id").desc_nulls_last(), F.col("tie")]
    heads = (
        docs.select("id", "tie")
        .repartitionByRange(ranges, *keys)
        .groupBy(F.spark_partition_id().alias("range"))
        .agg(F.max(F.struct(F.col("id").isNotNull().alias("some"), "id", (-F.col("tie")).alias("back"))).alias("head"))
        .select("head.id", "head.back")
        .collect()
    )
    rising = sorted(_order(h["id"], -h["back"]) for h in heads)

    # Arrow keeps ids as they are; in pandas a null among them would make them floating point.
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(ids: pa.Array, ties: pa.Array) -> pa.Array:
        out = []
        for ident, tie in zip(ids.to_pylist(), ties.to_pylist()):
            key = _order(ident, tie)
            at = bisect_left(rising, key)
            place = len(rising) - 1 - at
            own, guest = [2 * place], [2 * ((place - 1) % len(rising)) + 1]
            out.append(own + guest if rising[at] == key else own)
        return pa.array(out, pa.list_(pa.int32()))

    place = places("id", "tie")
    return docs.withColumn("place", F.explode(place)).select(
        F.expr("place div 2").alias("range"), (F.col("place") % 2).alias("guest"), *docs.columns
    )


def _compare(samples: int, id_type: pa.DataType):
    schema = pa.schema(
        [
            ("id", id_type),
            ("n_chars", pa.int64()),
            ("edited_text", pa.string()),
            ("fingerprint", pa.binary()),
            ("edited_fingerprint", pa.binary()),
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
        ]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, last = Draws(samples), None
        for batch in batches:
            out = []
            columns = (batch.column(n).to_pylist() for n in ("range", "guest", "id", "text"))
            for place, guest, ident, text in zip(*columns):
                if guest and last is None:
                    continue
                own = sample(bag(text), draws)
                if last is not None:
                    before, before_text, before_own = last
                    changed = edited(before_text, text)
                    other = sample(bag(changed), draws)
                    near = likeness(before_own, other), likeness(before_own, own)
                    prints = before_own.tobytes(), other.tobytes()
                    out.append((before, len(before_text), changed, *prints, *near))
                last = None if guest else (ident, text, own)
            columns = zip(*out) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

    return rows


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", samples: int = SAMPLES
) -> DataFrame:
    """One row for each row of ``docs``: id, n_chars, edited_text, fingerprint and
    edited_fingerprint (binary, 2 bytes a sample), near_edited and near_next.

    The next document is that of the next smaller id, after the last the first; null ids come
    last; ties go by a hash of the text. The edited text is :func:`edited`. Null text counts as
    empty; texts without words have a fingerprint of zeros and are alike; a lone document is its
    own next one; repeated rows keep a row each; an empty table gives an empty result; other
    columns are not looked at. The text moves once, to the range of its id.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # One value less than all, so that the tie can be negated.
    narrow = narrow.withColumn("tie", F.shiftright(F.xxhash64("text"), 1))
    kind = narrow.schema["id"].dataType
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        _dealt(narrow, RANGES * partitions)
        .repartition(partitions, "range")
        .sortWithinPartitions("range", "guest", F.col("id").desc_nulls_last(), "tie")
    )
    made = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_text", T.StringType()),
            T.StructField("fingerprint", T.BinaryType()),
            T.StructField("edited_fingerprint", T.BinaryType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )
    found = dealt.select("range", "guest", "id", "text").mapInArrow(
        _compare(samples, to_arrow_type(kind)), made
    )
    return found.withColumnRenamed("id", id_col)
