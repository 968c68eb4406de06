"""Exact token counts of every prefix by dynamic programming over its words.

The tokenizer drops white space and cuts there, so the count of a prefix that ends with a word is
the count before that word plus the word's own. One pass over the words of a text fills in the
counts of all such prefixes; questions about truncation and budgets are then look-ups. Inside a
word the counts of its own prefixes are kept the same way, once for each distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches, whole_text

#: Distinct words whose counts a task remembers; beyond that it starts anew.
CACHED_WORDS = 500_000
_WORD = regex.compile(r"\P{White_Space}+")
_NOT_SPACE = "\x1c\x1d\x1e\x1f"  # str.split takes these for white space, the tokenizer does not


def word_ends(text: str) -> tuple[list[str], list[int]]:
    """Words between white space, and the code points up to the end of each."""
    found = list(_WORD.finditer(text))
    return [m[0] for m in found], [m.end() for m in found]


def words(text: str) -> list[str]:
    """Words between white space."""
    if any(c in text for c in _NOT_SPACE):
        return _WORD.findall(text)
    return text.split()


class WordCounts(dict):
    """Token counts of words, each word tokenized once."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(tokenizer)
        self.model.no_truncation()
        self.model.no_padding()

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = n = len(self.model.encode(word, add_special_tokens=False).ids)
        return n

    def learn(self, found: set[str]) -> None:
        """Tokenizes those of the words that are not known yet, many at a time."""
        new = [w for w in found if w not in self]
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            new = list(found)
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            self.update(zip(part, (len(e) for e in self.model.encode_batch_fast(part, add_special_tokens=False))))

    def prefixes(self, word: str) -> list[int]:
        """Counts of the word's prefixes of 1, 2, ... code points."""
        return [self[word[:n]] for n in range(1, len(word) + 1)]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def prefix_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: the id, n_bytes (UTF-8), and ``counts``: entry i is the
    number of tokens of the prefix that ends with word i (words are runs without white space).

    The last entry is the count of the whole text; a text without words, empty or null has no
    entry and no tokens. Null and repeated ids keep a row each; an empty table gives an empty
    result; other columns are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(_read(tokenizer_path))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = WordCounts(model.value)
        for texts in batches:
            split = [words(t or "") for t in texts]
            known.learn(set().union(*split))
            yield pd.Series([np.cumsum([known[w] for w in ws], dtype=np.int32) for ws in split], dtype=object)

    return docs.select(
        F.col(id_col),
        F.octet_length(whole_text(text)).cast("long").alias("n_bytes"),
        counted(F.col(text)).alias("counts"),
    )


def total(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.get(counts, F.size(counts) - 1), F.lit(0)).cast("long")


def words_within(counts: Column, budget: int) -> Column:
    """The most words of a prefix whose tokens keep within ``budget``."""
    return F.size(F.filter(counts, lambda n: n <= budget))


def every_prefix(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The id and ``counts`` where entry n is the number of tokens of the first n code points, from
    0 to the whole text. Nulls, ties and empty tables as in :func:`prefix_counts`."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(_read(tokenizer_path))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = WordCounts(model.value)

        def counts(t: str) -> list[int]:
            out, before = [0], 0
            for word, end in zip(*word_ends(t)):
                out += [before] * (end - len(word) - len(out) + 1)
                inside = known.prefixes(word)
                out += [before + n for n in inside]
                before += inside[-1]
            return out + [before] * (len(t) + 1 - len(out))

        for texts in batches:
            yield pd.Series([counts(t or "") for t in texts], dtype=object)

    return docs.select(F.col(id_col), counted(F.col(text)).alias("counts"))


def code_points_within(counts: Column, budget: int) -> Column:
    """The longest prefix, in code points, such that it and all shorter ones keep within
    ``budget``; for the counts of :func:`every_prefix`."""
    over = F.transform(counts, lambda n, i: F.when(n > budget, i))
    return F.coalesce(F.array_min(over), F.size(counts)) - 1
