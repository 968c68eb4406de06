"""Byte-level BPE encoding and decoding around one shuffle of distinct words.

Documents are cut into blocks. A block yields each of its distinct pre-tokens once, in packets by
the hash of the word, and the place of every pre-token in its documents as one compressed array of
numbers. The packets of all blocks are dealt out by that hash, each distinct word is encoded once,
its ids go back to the blocks that hold it, and each block reassembles its documents by position.
So a frequent word moves once a block instead of once an occurrence, and texts do not move at all.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import give_back, small_batches

#: Bytes of text in a block, at most a document more.
BLOCK_BYTES = 3 << 20
#: Packets of words a block and shuffle partition.
PACKETS = 2


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64 and a number a line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def unicode_spaces(pattern: str) -> str:
    r"""The pattern with ``\s`` spelled out as Unicode white space; \x1c to \x1f are none."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Splitter:
    """Splits texts into pre-tokens.

    A text may be cut before each space that has a character other than white space on one side,
    and its pieces be split on their own. Pieces are named without that space, those that don't
    follow one with a space before their name, and only distinct ones are split by the pattern.
    """

    _LOOSE = regex.compile(r"(?<=\P{White_Space})(?= \P{White_Space})")
    _RARE = "\t\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
        map(chr, range(0x2000, 0x200B))
    )

    def __init__(self, pattern: str):
        self.pattern = regex.compile(unicode_spaces(pattern))

    def pieces(self, text: str) -> list[str]:
        if "  " in text or "\n " in text or any(c in text for c in self._RARE):
            parts = self._LOOSE.split(text)
            return [p[1:] if p[:1] == " " and p[1:2] not in (" ", "") else " " + p for p in parts]
        parts = text.split(" ")
        parts[0] = " " + parts[0]
        return parts

    def words(self, piece: str) -> list[str]:
        if piece.isalpha():
            return [" " + piece]
        return self.pattern.findall(piece[1:] if piece[:1] == " " else " " + piece)


def _ragged(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[offsets[i]:offsets[i + 1]] for i in ``index``, joined, and their lengths."""
    lengths = (offsets[1:] - offsets[:-1])[index]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(offsets[:-1][index], lengths)
    return flat[at], lengths


def _distinct_words(texts: list[str], splitter: Splitter):
    """Pieces of each text, distinct pieces, words of each distinct piece, and distinct words;
    distinct ones in the order in which they come up."""
    docs = [splitter.pieces(t) if t else [] for t in texts]
    pieces = dict.fromkeys(chain.from_iterable(docs))
    split = [splitter.words(p) for p in pieces]
    return docs, pieces, split, dict.fromkeys(chain.from_iterable(split))


def _places(texts: list[str], splitter: Splitter) -> tuple[bytes, bytes]:
    """The number of each pre-token among the distinct ones, compressed, and pre-tokens a text."""
    docs, pieces, split, words = _distinct_words(texts, splitter)
    word_no = dict(zip(words, range(len(words))))
    piece_no = dict(zip(pieces, range(len(pieces))))
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = np.fromiter(map(word_no.__getitem__, chain.from_iterable(split)), np.uint32, int(sizes.sum()))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    index = np.fromiter(map(piece_no.__getitem__, chain.from_iterable(docs)), dtype=np.int64)
    places, lengths = _ragged(flat, offsets, index)
    of_doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    per_doc = np.bincount(of_doc, weights=lengths, minlength=len(docs)).astype(np.uint32)
    # Low and high halves apart: the high half is mostly zeros.
    halves = np.concatenate((places.astype(np.uint16), (places >> 16).astype(np.uint16)))
    return _pack(halves), per_doc.tobytes()


def _pack(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as all their first bytes, all their second bytes and so on, which packs well."""
    return np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _packet(nos: np.ndarray, items: list[bytes], ids: bool = False) -> bytes:
    """Rising numbers with a run of bytes each; of token ids if ``ids``."""
    lengths = np.fromiter(map(len, items), np.uint32, len(items))
    count = np.array([len(items)], "<u4").tobytes()
    body = b"".join(items)
    if ids:
        body = _planes(np.frombuffer(body, "<u4"))
    return _pack(count, _planes(np.diff(nos, prepend=0)), _planes(lengths), body)


def _items(packed: bytes, ids: bool = False) -> tuple[np.ndarray, list[bytes]]:
    raw = _unpack(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    nos = np.cumsum(_from_planes(raw, n, 4), dtype=np.int64)
    lengths = _from_planes(raw, n, 4 + 4 * n)
    ends, at = np.cumsum(lengths, dtype=np.int64), 4 + 8 * n
    body = _from_planes(raw, (len(raw) - at) // 4, at).tobytes() if ids else raw[at:]
    return nos, [body[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """Blocks of ids and texts, numbered by a hash of what they hold."""

    def closed(ids: list, texts: list[str]) -> tuple[int, list, list[str]]:
        digest = hashlib.blake2b(repr(ids).encode(), digest_size=8)
        for t in texts:
            digest.update(t.encode("utf-8", "surrogatepass"))
        return int.from_bytes(digest.digest(), "little", signed=True), ids, texts

    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(ident)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield closed(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield closed(ids, texts)


def _word_rows(pattern: str, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(pattern)
        for block, _, texts in _blocks(batches):
            words = [w.encode("utf-8", "surrogatepass") for w in _distinct_words(texts, splitter)[-1]]
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            found, starts = np.unique(bucket[order], return_index=True)
            parts = np.split(order, starts[1:]) if len(found) else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found, pa.int32()),
                    pa.array([block] * len(found), pa.int64()),
                    pa.array([_packet(p, [words[i] for i in p.tolist()]) for p in parts], pa.binary()),
                ],
                names=["bucket", "block", "packet"],
            )
            del words, order, parts
            give_back()

    return rows


def _place_rows(pattern: str, id_type: pa.DataType):
    schema = pa.schema(
        [("block", pa.int64()), ("ids", pa.list_(id_type)), ("places", pa.binary()), ("sizes", pa.binary())]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(pattern)
        for block, ids, texts in _blocks(batches):
            places, sizes = _places(texts, splitter)
            columns = [pa.array([v], t) for v, t in zip((block, ids, places, sizes), schema.types)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            del places, sizes, columns
            give_back()

    return rows


def _encode_packets(ranks):
    """Packets of words, sorted by bucket, as packets of ids; each distinct word is encoded once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        whole = tiktoken.Encoding(
            "whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={}
        )

        class Coded(dict):
            def __missing__(self, word: bytes) -> bytes:
                ids = whole.encode_ordinary(word.decode("utf-8", "surrogatepass"))
                self[word] = coded = np.array(ids, dtype="<u4").tobytes()
                return coded

        at, coded = None, Coded()
        for batch in batches:
            out = []
            for bucket, packet in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if bucket != at:
                    at, coded = bucket, Coded()
                nos, words = _items(packet)
                out.append(_packet(nos, [coded[w] for w in words], ids=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(out, pa.binary())], names=["block", "packet"]
            )
        del coded
        give_back()

    return rows


def _reassemble(id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("tokens", pa.binary())])

    def rows(packets: pa.Table, blocks: pa.Table) -> pa.Table:
        # Blocks that hold the same are numbered alike; their words come more than once.
        coded: dict[int, bytes] = {}
        for packet in packets.column("packet").to_pylist():
            nos, items = _items(packet, ids=True)
            coded.update(zip(nos.tolist(), items))
        parts = [coded[i] for i in range(len(coded))]
        flat = np.frombuffer(b"".join(parts), dtype="<u4")
        offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)))
        made_ids, made = [], []
        for row in blocks.to_pylist():
            halves = np.frombuffer(_unpack(row["places"]), np.uint16)
            low, high = halves[: len(halves) // 2], halves[len(halves) // 2 :]
            places = low.astype(np.int64) + (high.astype(np.int64) << 16)
            all_ids, lengths = _ragged(flat, offsets, places)
            word_ends = np.cumsum(np.frombuffer(row["sizes"], np.uint32), dtype=np.int64)
            id_ends = np.concatenate(([0], np.cumsum(lengths)))[word_ends]
            raw, start = all_ids.astype("<u4").tobytes(), 0
            for ident, end in zip(row["ids"], id_ends.tolist()):
                made_ids.append(ident)
                made.append(raw[4 * start : 4 * end])
                start = end
        table = pa.Table.from_arrays([pa.array(made_ids, id_type), pa.array(made, pa.binary())], schema=schema)
        del coded, parts, flat, made
        give_back()
        return table

    return rows


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, tokens) for each row of ``docs``; tokens are the ids as little-endian unsigned 32-bit
    integers, :func:`token_array` makes an array of them.

    Null text counts as empty and has no tokens; null and repeated ids keep a row each; an empty
    table gives an empty result; other columns are not looked at. Blocks are cut twice from
    ``docs``, for words and for places; they are named by what they hold, so that a recomputation
    that cuts otherwise can't mix them up: a block without its words fails the query.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = narrow.schema["id"].dataType
    arrow = to_arrow_type(kind)
    buckets = PACKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = (
        narrow.mapInArrow(_word_rows(pattern, buckets), "bucket int, block long, packet binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_encode_packets(ranks), "block long, packet binary")
    )
    blocks = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("places", T.BinaryType()),
            T.StructField("sizes", T.BinaryType()),
        ]
    )
    placed = narrow.mapInArrow(_place_rows(pattern, arrow), blocks)
    made = T.StructType([T.StructField("id", kind), T.StructField("tokens", T.BinaryType())])
    joined = coded.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(_reassemble(arrow), made)
    return joined.withColumnRenamed("id", id_col)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def token_array(tokens: pd.Series) -> pd.Series:
    """The ids of :func:`encode` as an array of integers."""
    return tokens.map(lambda b: np.frombuffer(b, "<u4").astype(np.int32))


def decode(tokens: DataFrame, ranks_path: str, name: str = "tokens") -> DataFrame:
    """``tokens`` with a binary column ``decoded``: the bytes of the ids in ``name``, joined with
    the table of token bytes. The table is the vocabulary, fixed by its file whatever the data, so
    every task holds it. An unknown id fails."""
    spark: SparkSession = tokens.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    table: dict[int, bytes] = {}

    # Not an iterator of batches, so that it shares one Python worker with :func:`token_array`.
    @F.pandas_udf(T.BinaryType())
    def decoded(values: pd.Series) -> pd.Series:
        if not table:  # once a task
            table.update((i, b) for b, i in ranks.value.items())
        return values.map(lambda v: b"".join(map(table.__getitem__, np.frombuffer(v, "<u4").tolist())))

    return tokens.withColumn("decoded", decoded(F.col(name)))
