"""Exact duplicates by stateful streaming, JVM side throughout.

Narrow rows (digest, identifier, length, content locator) are streamed into keyed state that
RocksDB holds on disk. A key never expires: it retains the digest, the identifier, length and
locator of the best row seen, and the number of rows. The state is then read as a table. Digests
seen more than once are hits; for them the full bytes are compared before rows count as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import new_run_dir
from tidemark.llm.common import fresh, keep_one, staged, whole_text

STATE_STORE = {
    "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # One cache and write buffer for all state of an executor; what exceeds it is on disk.
    "rocksdb.boundedMemoryUsage": "true",
    "rocksdb.maxMemoryUsageMB": "128",
    # A store of few keys takes little room; allotted ahead, each would take megabytes.
    "rocksdb.allowFAllocate": "false",
}
FILES_PER_TRIGGER = 512
FILTER_BITS = 1 << 23
_BITMAP_BITS = 32768  # of one bitmap that bitmap_construct_agg makes


def normalised(text: str | Column = "text") -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]+", "")


def digest_of(normal: Column, bytes_kept: int = 32) -> Column:
    """SHA-256 as binary; ``bytes_kept`` shortens it, to try out collisions."""
    full = F.unhex(F.sha2(normal.cast("binary"), 256))
    return full if bytes_kept == 32 else F.substring(full, 1, bytes_kept)


def _rank() -> Column:
    """Smaller is better: most code points, smallest id (nulls last), first row."""
    return F.struct(
        (-F.col("chars")).alias("neg_chars"), F.col("id").isNull().alias("no_id"), "id", "row"
    )


def keyed_state(
    spark: SparkSession, rows_path: str, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """Streams the rows written at ``rows_path`` through the keyed state and returns the state as
    (digest, n, best: struct of rank and file)."""
    for key, value in STATE_STORE.items():
        spark.conf.set(f"spark.sql.streaming.stateStore.{key}", value)
    rows = spark.read.parquet(rows_path)
    stream = (
        spark.readStream.schema(rows.schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(rows_path)
    )
    keyed = stream.groupBy("digest").agg(
        F.count("*").alias("n"), F.min(F.struct(_rank().alias("rank"), "file")).alias("best")
    )
    log = new_run_dir(spark, "dedup-state")
    query = (
        keyed.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", log)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not query.recentProgress:  # no batch ran, so there is no state to read
        return spark.createDataFrame([], keyed.schema)
    state = spark.read.format("statestore").load(log).select("key.digest", "value.*")
    return state.toDF("digest", "n", "best")


def _may_hit(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Those of ``rows`` whose digest may be among ``hits``; none whose digest is gets lost.

    A bit field of fixed size stands for the hits: 256 bitmaps of 4 KB, so what is broadcast is
    1 MB at most whatever the data. Rows that share a bit by chance pass too and do no harm.
    """
    bit = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long") % FILTER_BITS
    place = f"__bit div {_BITMAP_BITS}"
    bitmaps = (
        hits.select(bit.alias("__bit"))
        .groupBy(F.expr(place).alias("__part"))
        .agg(F.bitmap_construct_agg(F.expr(f"__bit % {_BITMAP_BITS}")).alias("__bits"))
    )
    byte = f"conv(hex(substring(__bits, cast(__bit % {_BITMAP_BITS} div 8 as int) + 1, 1)), 16, 10)"
    return (
        rows.withColumn("__bit", bit)
        .withColumn("__part", F.expr(place))
        .join(F.broadcast(bitmaps), "__part")
        .where(F.expr(f"getbit(cast({byte} as int), cast(__bit % 8 as int)) = 1"))
        .drop("__bit", "__part", "__bits")
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    bytes_kept: int = 32,
    files_per_trigger: int = FILES_PER_TRIGGER,
) -> DataFrame:
    """One row for each row of ``docs``: id, chars, digest, keep_id, keep_file (where the row that
    stays was read; empty if not from a file), group_size, kept.

    Null text counts as empty; all empty texts are one group. Of equal texts the one with the most
    code points in the original stays, then the smallest id, nulls last, then any one row: of
    repeated rows exactly one is kept. Empty tables give an empty result. Other columns are not
    looked at. ``docs`` is read twice.
    """
    spark = docs.sparkSession
    path = f"{new_run_dir(spark, 'digests')}/rows"
    docs.select(
        F.col(id_col).alias("id"),
        F.length(whole_text(text)).cast("long").alias("chars"),
        digest_of(normalised(text), bytes_kept).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
        F.input_file_name().alias("file"),
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    state = staged(keyed_state(spark, path, files_per_trigger), "dedup-keys")

    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("__text")).select(
        "id", F.length(whole_text("__text")).cast("long").alias("chars"), normalised("__text").alias("normal")
    )
    texts = texts.withColumn("digest", digest_of(F.col("normal"), bytes_kept))
    suspects = _may_hit(texts.select("digest", "normal"), state.where("n > 1"))
    collided = staged(
        suspects.groupBy("digest", "normal")
        .agg(F.count("*").alias("rows"))
        .groupBy("digest")
        .agg(F.count("*").alias("classes"))
        .where("classes > 1")
        .select("digest"),
        "collided",
    )
    result = rows.join(state, "digest").select(
        "id",
        "chars",
        "digest",
        F.col("best.rank.id").alias("keep_id"),
        F.col("best.file").alias("keep_file"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.rank.row")).alias("kept"),
    )
    if collided.isEmpty():
        return result
    # Different texts with one digest: told apart by their bytes.
    same = Window.partitionBy("digest", "normal")
    best = same.orderBy(F.desc("chars"), F.col("id").asc_nulls_last())
    apart = texts.join(collided, "digest", "left_semi").select(
        "id",
        "chars",
        "digest",
        F.first("id").over(best).alias("keep_id"),
        F.lit("").alias("keep_file"),
        F.count("*").over(same).alias("group_size"),
        (F.row_number().over(best) == 1).alias("kept"),
    )
    return result.join(collided, "digest", "left_anti").select(apart.columns).unionByName(apart)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, chosen as in :func:`exact_groups`. All
    columns stay as they are."""
    digest, chars = fresh(docs, "digest"), fresh(docs, "chars")
    groups = staged(exact_groups(docs, id_col, text), "exact-groups")
    ties = groups.groupBy("digest", "id", "chars").agg(F.count("*").alias("ties"))
    kept = groups.where("kept").select("digest", "id", "chars")
    decision = staged(
        kept.join(
            ties,
            (kept.digest == ties.digest) & (kept.chars == ties.chars) & kept.id.eqNullSafe(ties.id),
        ).select(kept.digest, kept.id, kept.chars, "ties"),
        "kept",
    )
    marked = docs.withColumn(digest, digest_of(normalised(text))).withColumn(
        chars, F.length(whole_text(text)).cast("long")
    )
    on = {digest: "digest", chars: "chars", id_col: "id"}
    return keep_one(marked, decision, on, "ties").drop(digest, chars)
