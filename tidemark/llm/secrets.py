"""Secret scans with columns only: fixed patterns, and windows of high entropy in candidate strings.

Patterns give matches without places. A place is the sum of what comes before: the text split at
the matches gives the gaps between them, so a match starts after all earlier gaps and matches.
These sums run over rows of matches, a window a document, so a text with countless matches costs
no more than its matches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged, whole_text


@dataclass(frozen=True)
class Kind:
    """A pattern, and the length that its ``group`` must have for a match to count."""

    name: str
    pattern: str
    least: int
    group: int = 0


# Runs of a class are found whole, so asking for the least length in the pattern itself finds what
# dropping short runs afterwards would. A short assignment must be found to be passed over.
KINDS = (
    Kind(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 20),
    Kind("hex", r"[0-9a-f]{24,}", 24),
)


@dataclass(frozen=True)
class EntropyClass:
    """A character class, its candidate strings, and the bits that a window of them must reach."""

    name: str
    alphabet: str
    candidate: str
    window: int
    bits: float


# Runs of hex in any case, whatever they are joined to; a run as long as a window is enough.
CLASSES = (
    EntropyClass("entropy_hex", "0123456789ABCDEFabcdef", r"[0-9A-Fa-f]{20,}", 20, 3.0),
    EntropyClass(
        "entropy_base64",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
        r"[A-Za-z0-9+/_-]{20,}",
        20,
        3.6,
    ),
)

# Segments and their repetitions are possessive: what they took is never given back, so that a long
# candidate is gone through once, in a loop and not by recursion.
_WORD = r"[A-Z]?[a-z]++|[A-Z]++|[0-9]++"
_MARKED = r"(?=[A-Za-z0-9+]*?(?i:abcdefgh|01234567|example|placeholder|x{6}))[A-Za-z0-9+]++"

#: Candidates that are no secrets, or that a kind above has: without digits or digits alone, lower
#: hex, words and numbers joined by - _ or /, UUIDs. Alphabets in order and marked examples count
#: for the segment between - _ and / that holds them: the others must be words or numbers.
ALLOWED = (
    r"^[^0-9]++$",
    r"^[0-9]++$",
    r"^[0-9a-f]{24,}+$",
    rf"^(?:{_WORD})(?:[-_/]++(?:{_WORD}))++$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    rf"^[-_/]*+(?:{_MARKED}|{_WORD})(?:[-_/]++(?:{_MARKED}|{_WORD}))*+[-_/]*+$",
)


def _window_spans(codes: Column, kind: EntropyClass) -> Column:
    """Spans (begin, end) of windows that reach the entropy, joined where they meet; ``codes`` are
    the candidate's characters by their place in the alphabet.

    A step changes the counts of the characters in the window by one that enters and one that
    leaves. With S the sum of c*log2(c) over the counts c the entropy is log2(w) - S/w, so a step
    changes S by four terms; no window is counted anew. A candidate shorter than w has no span.
    """
    size, none = kind.window, F.lit(-1)
    span = "array<struct<begin:int,end:int>>"

    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(0.0)

    def step(state: Column, at: Column) -> Column:
        entering = F.get(codes, at - 1)
        leaving = F.coalesce(F.when(at > size, F.get(codes, at - 1 - size)), none)
        before = F.coalesce(F.get(state["counts"], leaving), F.lit(0))
        held = F.get(state["counts"], entering) - (entering == leaving).cast("int")
        s = state["s"] - term(before) + term(before - 1) - term(held) + term(held + 1)
        counts = F.transform(
            state["counts"],
            lambda c, i: c + (i == entering).cast("int") - (i == leaving).cast("int"),
        )
        high = (at >= size) & (math.log2(size) - s / size >= kind.bits)
        apart = high & (state["end"] < at - size)
        done = F.struct(state["begin"].alias("begin"), state["end"].alias("end"))
        return F.struct(
            counts.alias("counts"),
            s.alias("s"),
            F.when(apart, at - size).otherwise(state["begin"]).alias("begin"),
            F.when(high, at).otherwise(state["end"]).alias("end"),
            F.when(apart & (state["end"] >= 0), F.array_append(state["spans"], done))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    def last(state: Column) -> Column:
        done = F.struct(state["begin"].alias("begin"), state["end"].alias("end"))
        return F.when(state["end"] >= 0, F.array_append(state["spans"], done)).otherwise(state["spans"])

    start = F.struct(
        F.array_repeat(F.lit(0), len(kind.alphabet)).alias("counts"),
        F.lit(0.0).alias("s"),
        none.alias("begin"),
        none.alias("end"),
        F.array().cast(span).alias("spans"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, last)


_FOUND = "array<struct<kind:int,place:int,gap:int,length:int,counted:int,value:string>>"


def _found(text: Column, no: int, pattern: str, group: int = 0, with_value: bool = False) -> Column:
    """Matches of a pattern as (kind, place, gap before it, length, length of the group, value).
    Only a text with matches is split."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    grouped = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    zipped = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        matches.alias("value"),
        F.transform(grouped, F.length).alias("counted"),
    )
    rows = F.transform(
        F.slice(zipped, F.lit(1), F.size(matches)),
        lambda m, i: F.struct(
            F.lit(no).alias("kind"),
            i.alias("place"),
            m["gap"].alias("gap"),
            F.length(m["value"]).alias("length"),
            m["counted"].alias("counted"),
            (m["value"] if with_value else F.lit(None).cast("string")).alias("value"),
        ),
    )
    return F.when(F.size(matches) > 0, rows).otherwise(F.array()).cast(_FOUND)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id and ``spans``, an array of (start, kind_no, kind,
    stop) by start, then kind as listed in KINDS and CLASSES; code points, stop exclusive.

    Spans of KINDS are all matches that are long enough, leftmost first, not overlapping within a
    kind. Spans of CLASSES are joined windows of high entropy in candidates that ALLOWED doesn't
    suppress; they may overlap others. Null and empty texts have no spans; null and repeated ids
    keep a row each; an empty table gives an empty result; other columns are not looked at.
    """
    whole = whole_text(text)
    parts = [_found(whole, i, k.pattern, k.group) for i, k in enumerate(KINDS)]
    parts += [_found(whole, len(KINDS) + i, c.candidate, 0, True) for i, c in enumerate(CLASSES)]
    scanned = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.concat(*parts).alias("found"),
        ),
        "secrets",
    )
    each = scanned.select("row", F.inline("found"))
    earlier = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("start", (F.sum(F.col("gap") + F.col("length")).over(earlier) - F.col("length")).cast("int"))
    least = F.element_at(F.array(*[F.lit(k.least) for k in KINDS]), F.col("kind") + 1)
    fixed = placed.where(f"kind < {len(KINDS)}").where(F.col("counted") >= least)
    spans = fixed.select("row", "kind", "start", (F.col("start") + F.col("length")).alias("stop"))
    for i, c in enumerate(CLASSES):
        open_ones = placed.where(F.col("kind") == len(KINDS) + i)
        for allowed in ALLOWED:
            open_ones = open_ones.where(~F.col("value").rlike(allowed))
        alphabet = F.lit(c.alphabet)
        codes = F.transform(F.split("value", ""), lambda ch: F.position(ch, alphabet) - 1)  # noqa: B023
        windows = open_ones.withColumn("codes", codes).select(
            "row", "kind", "start", F.explode(_window_spans(F.col("codes"), c)).alias("w")
        )
        spans = spans.unionByName(
            windows.select(
                "row",
                "kind",
                (F.col("start") + F.col("w.begin")).alias("start"),
                (F.col("start") + F.col("w.end")).alias("stop"),
            )
        )
    names = F.array(*[F.lit(x.name) for x in (*KINDS, *CLASSES)])
    span = F.struct(
        "start", F.col("kind").alias("kind_no"), F.get(names, F.col("kind")).alias("kind"), "stop"
    )
    gathered = spans.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.array().cast("array<struct<start:int,kind_no:int,kind:string,stop:int>>")
    return (
        scanned.select("row", "id")
        .join(gathered, "row", "left")
        .select(F.col("id").alias(id_col), F.coalesce("spans", empty).alias("spans"))
    )


def listed(spans: Column) -> Column:
    """Spans as kind:start:stop, joined by commas."""
    each = F.transform(
        spans,
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")),
    )
    return F.array_join(each, ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def fixed_spans(spans: Column) -> Column:
    """The spans of KINDS alone."""
    return F.filter(spans, lambda s: s["kind_no"] < len(KINDS))
