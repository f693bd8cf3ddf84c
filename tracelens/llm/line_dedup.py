"""Line dedup by overlapping windows of three lines, with DataFrame functions only.

Every three consecutive lines are hashed (128 bits); the first occurrence of a window, by (doc_id, text hash, line),
stays, and the lines under later ones go, covered positions merged. Windows of blank lines only (white space: space,
tab, line feed, vertical tab, form feed, carriage return) don't count, and
texts of under three lines have no window. Null texts count as empty. Rows with equal doc_id and text are one
document here: their own lines never count as copies of each other, and both get the same result.

Nothing is collected or paired: a window's first place is a partial aggregate, and the join back to the places is
an equi-join on the hash that adaptive execution splits where one window is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = 3
#: Characters of a blank line.
BLANK = " \t\n\x0b\f\r"


def _windows(docs: DataFrame, size: int) -> DataFrame:
    lines = F.split("text", "\n", -1)
    d = docs.select("id", "text_hash", lines.alias("lines")).where(F.size("lines") >= size)

    def window(i: Column) -> Column:
        ls = [F.get("lines", i + k) for k in range(size)]
        blank = F.btrim(F.concat(*ls), F.lit(BLANK)) == ""
        return F.when(~blank, F.struct(F.xxhash64(*ls).alias("h1"), F.xxhash64(F.lit("second"), *ls).alias("h2")))

    d = d.select("id", "text_hash", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - size), window)).alias("pos", "w"))
    return d.where("w is not null").select(F.struct("id", "text_hash", "pos").alias("place"), "w.h1", "w.h2")


def covered_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """Per document (id, text_hash) the merged spans (from, to) of lines to remove, in order."""
    windows = _windows(docs, size)
    first = windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).where("place > first").select("place.*")
    by_doc = Window.partitionBy("id", "text_hash").orderBy("pos")
    starts = F.coalesce((F.col("pos") > F.lag("pos").over(by_doc) + size), F.lit(True))
    later = later.withColumn("starts", starts.cast("int")).withColumn("island", F.sum("starts").over(by_doc))
    spans = later.groupBy("id", "text_hash", "island").agg(F.min("pos").alias("from"), (F.max("pos") + size).alias("to"))
    return spans.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = LINES) -> DataFrame:
    """docs with text_col cleaned, and lines_before and lines_removed (long) added. All other columns stay."""
    key = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = key.withColumn("text_hash", F.xxhash64("text"))
    spans = covered_lines(key, size)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    all_rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), row.alias("row"))
    j = all_rows.alias("a").join(spans.alias("b"), (F.col("a.id").eqNullSafe(F.col("b.id"))) & (F.col("a.text_hash") == F.col("b.text_hash")), "left")
    j = j.select("row", "spans", F.split(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), "\n", -1).alias("lines"))
    n = F.size("spans")

    def kept(i: Column) -> Column:
        lo = F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["to"])
        hi = F.when(i == n, F.size("lines")).otherwise(F.get("spans", i)["from"])
        return F.slice("lines", lo + 1, hi - lo)

    clean = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), kept)), "\n")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    text = F.when(F.col("spans").isNotNull(), clean).otherwise(F.col(f"row.`{text_col}`"))
    before = F.when(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")) == "", F.lit(0)).otherwise(F.size("lines"))
    return j.select(
        *[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns],
        before.cast("long").alias("lines_before"), F.coalesce(removed, F.lit(0)).cast("long").alias("lines_removed"),
    )
