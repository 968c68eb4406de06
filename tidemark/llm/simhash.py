"""SimHash fingerprints and near-duplicate groups by full-key neighbourhoods.

A fingerprint is cut into two segments of 32 bits. Two fingerprints at 2 or fewer differing bits
differ by at most one bit in one of the segments, or by two bits in one and none in the other. Each
distinct fingerprint is filed under every key of the Hamming ball of radius 1 inside either
segment, the other segment unchanged: 65 keys, whatever the data. Two fingerprints within distance
2 meet under a common key: both bits in one segment, under the key with one of them turned; one
bit in either segment, under the key with one turned. Whoever meets is at most 2 bits
apart, so a key holds 65 fingerprints at most, however many documents are alike; a group never
becomes pairs. Each one is linked with the smallest under its key after its complete distance was
verified: all under a key are in one component anyway. No candidate is dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, keep_one, small_batches, staged
from tidemark.llm.graph import components

SEED = 42
RADIUS = 2
_CHUNK = 1 << 16


def simhash(text: str | None, width: int = 3) -> int:
    """Signed 64-bit fingerprint of the word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    size = min(width, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8), bitorder="little")
        votes += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _simhash3(text: pd.Series) -> pd.Series:
    return text.map(simhash).astype("int64")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of its 3-word shingles as a long. Null counts as empty."""
    small_batches(docs.sparkSession)
    return docs.withColumn(name, _simhash3(F.col(text)))


def near_links(prints: DataFrame, name: str = "fingerprint") -> DataFrame:
    """(u, v) links between the distinct fingerprints of ``prints``, enough to connect all that
    lie within 2 bits of each other; at most 65 a fingerprint."""
    turned = [F.col("u")] + [F.col("u").bitwiseXOR(F.lit(_bit(i)).cast("long")) for i in range(64)]
    filed = (
        prints.select(F.col(name).alias("u")).distinct().select("u", F.explode(F.array(*turned)).alias("key"))
    )
    met = filed.withColumn("v", F.min("u").over(Window.partitionBy("key")))
    distance = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    return met.where((F.col("u") != F.col("v")) & (distance <= RADIUS)).select("u", "v").distinct()


def _bit(i: int) -> int:
    return (1 << i) - (1 << 64 if i == 63 else 0)


def near_groups(prints: DataFrame, id_col: str = "doc_id", name: str = "fingerprint") -> DataFrame:
    """(fingerprint, root, component_id, group_size) of each distinct fingerprint in ``prints``:
    component_id is the smallest id of all rows whose fingerprint can be reached over links,
    group_size their number. Null ids count in group_size and are passed over as component_id; a
    group of null ids alone has a null component_id. ``prints`` is read several times.
    """
    own = staged(prints.groupBy(name).agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "prints")
    roots = components(near_links(own, name)).select(F.col("node").alias(name), "root")
    rooted = staged(
        own.join(roots, name, "left").withColumn("root", F.coalesce("root", name)), "rooted"
    )
    groups = rooted.groupBy("root").agg(
        F.min("low").alias("component_id"), F.sum("n").alias("group_size")
    )
    return rooted.join(groups, "root").select(name, "root", "component_id", "group_size")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, fingerprint (long), component_id, group_size.

    Null text counts as empty, texts without words share fingerprint 0, repeated rows and ids stay
    rows of their own, an empty table gives an empty result, other columns are not looked at.
    """
    narrow = docs.select(F.col(id_col).alias(id_col), F.col(text).alias("__text"))
    prints = staged(
        with_fingerprint(narrow, "__text").drop("__text"), "simhash"
    )
    return prints.join(near_groups(prints, id_col), "fingerprint").select(
        id_col, "fingerprint", "component_id", "group_size"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id (nulls last),
    of rows with the same id that with the smaller fingerprint, of equals any one. All columns
    stay as they are."""
    mark = fresh(docs, "simhash")
    marked = with_fingerprint(docs, text, mark)
    prints = staged(marked.select(F.col(id_col).alias("id"), F.col(mark).alias("fingerprint")), "simhash")
    groups = near_groups(prints, "id")
    ranked = (
        prints.groupBy("id", "fingerprint")
        .agg(F.count("*").alias("ties"))
        .join(groups.withColumnRenamed("component_id", "low"), "fingerprint")
        .where(F.col("id").eqNullSafe(F.col("low")))
    )
    # Rows with one id may lie in one group with different fingerprints, and groups of null ids
    # alone have no name: the group's root tells them apart.
    best = ranked.groupBy("root", "id").agg(F.min(F.struct("fingerprint", "ties")).alias("best"))
    kept = staged(best.select("id", "best.fingerprint", "best.ties"), "kept")
    return keep_one(marked, kept, {id_col: "id", mark: "fingerprint"}, "ties").drop(mark)
