"""Line dedup: shared lines stay in the first document only.

All of it is DataFrame functions. A written table holds a 128-bit hash, the
document and the position of every line; it is range-partitioned by hash with
document and position as secondary order, and the first holder streams along
each run of equal hashes. What comes back is a bitmap per document, in 64-line
words, of which only words with a dropped line are stored.

A line so common that one range could not hold it (a sketch finds the hashes
with more than a part in ``HOT_PARTS`` of all lines) goes another, equally exact
way: its first holder is a minimum, combined before the shuffle, and at most
``HOT_PARTS`` such minima are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import NO_ID, SPACES, written

HOT_PARTS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _named(docs: DataFrame, *extra: Column) -> DataFrame:
    """Documents by id and hash of the text; a null id counts as the largest."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("__doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("__body"), *extra,
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(__doc, __body, keep, n_dropped)`` of every document that loses a line.

    A line's key is the line without outer white space, A-Z in lower case. A key
    of at least ``min_chars`` code points stays only in the smallest doc_id that
    holds it, there in every line. ``keep`` maps a word number to 64 keep bits;
    a word that is not there keeps all its lines. Rows with the same doc_id are
    one document whatever their texts; a null text is one empty line; a null id
    counts as the largest id. An empty table gives no row.
    """
    key = F.translate(F.btrim("line", F.lit(SPACES)), UPPER, LOWER)
    found = (
        _named(docs, F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("__doc", "__body", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("__doc", "__body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    lines = written(found, "lines")
    total, top = lines.agg(F.count("*"), F.expr(f"approx_top_k(h1, {HOT_PARTS}, {100 * HOT_PARTS})")).first()
    hot = [r["item"] for r in top or [] if r["count"] * HOT_PARTS > total]

    slices = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "__doc", "pos"]
    ranged = lines.where(~F.col("h1").isin(hot)) if hot else lines
    ranged = ranged.repartitionByRange(slices, "h1", "h2").sortWithinPartitions(*order)
    along = Window.partitionBy("h1", "h2").orderBy("__doc", "pos").rowsBetween(Window.unboundedPreceding, 0)
    late = ranged.withColumn("first_doc", F.first("__doc").over(along)).where("__doc > first_doc")
    late = late.select("__doc", "__body", "pos")
    if hot:
        common = lines.where(F.col("h1").isin(hot))
        firsts = common.groupBy("h1", "h2").agg(F.min("__doc").alias("first_doc"))
        again = common.join(F.broadcast(firsts), ["h1", "h2"]).where("__doc > first_doc")
        late = late.unionByName(again.select("__doc", "__body", "pos"))
    words = late.groupBy("__doc", "__body", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits")
    )
    return words.groupBy("__doc", "__body").agg(
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"),
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"),
    )


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``__lines`` (how many before), ``__dropped`` and ``__kept`` (the text of the lines that stay)."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = _named(docs, F.struct(*own).alias("__row"))
    text = F.col("__row.text")

    def stays(_, i):
        return F.coalesce(F.getbit(F.element_at("__keep", F.shiftright(i, 6)), i.bitwiseAND(63)) == 1, F.lit(True))

    kept = F.array_join(F.filter(_lines(text), stays), "\n")
    # names of their own: a column of ``docs`` may be called keep
    marks = bitmaps.withColumnsRenamed({"keep": "__keep", "n_dropped": "__n_dropped"})
    return rows.join(marks, ["__doc", "__body"], "left").select(
        "__row.*",
        F.size(_lines(text)).cast("bigint").alias("__lines"),
        F.coalesce("__n_dropped", F.lit(0)).cast("bigint").alias("__dropped"),
        F.when(F.col("__keep").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept).alias("__kept"),
    )


def drop_shared_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` without their repeated lines; a null text stays null, ``n_chars`` follows the new text."""
    out = kept_lines(docs, keep_bitmaps(docs, min_chars))
    text = F.when(F.col("text").isNotNull(), F.col("__kept"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__dropped") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*[f"`{c}`" for c in docs.columns])
