"""Line dedup by overlapping three-line windows, with built-in functions only.

Each run of three consecutive lines is hashed; a window that occurs more than
once anywhere is kept where it comes first and cut out everywhere else. The
windows overlap, so a long repeated passage is covered by the union of its
windows. The first place is found by an aggregation that is combined before its
shuffle, so a line that a third of all documents hold costs no more than any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.llm.common import order_id, text_key

WINDOW = 3


def _windows(lines: str, size: int) -> Column:
    """array<struct<pos, h1, h2>>: hashes of each run of lines; a shorter text is one run."""
    n = F.size(lines)
    starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))

    def window(at: Column) -> Column:
        run = F.slice(lines, at + 1, F.lit(size))
        blank = F.trim(F.array_join(run, "")) == ""
        return F.when(~blank, F.struct(at.alias("pos"), F.xxhash64(run).alias("h1"), F.xxhash64(F.lit(1), F.reverse(run)).alias("h2")))

    return F.filter(F.transform(starts, window), lambda x: x.isNotNull())


def window_occurrences(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """id, key, pos, h1, h2: every window of every document that isn't all blank."""
    lines = docs.select(order_id().alias("id"), text_key().alias("key"), F.split("text", "\n", -1).alias("lines"))
    return lines.select("id", "key", F.explode(_windows("lines", size)).alias("w")).select("id", "key", "w.*")


def later_occurrences(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """id, key, pos: windows that came before, in the order of (id, key, pos)."""
    occurrences = window_occurrences(docs, size)
    here = F.struct("id", "key", "pos")
    repeated = occurrences.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first != last").select("h1", "h2", "first")
    return occurrences.join(repeated, ["h1", "h2"]).where(here != F.col("first")).select("id", "key", "pos")


def dedup_lines(docs: DataFrame, size: int = WINDOW, counts: bool = True) -> DataFrame:
    """docs with repeated windows cut from text; with counts two columns follow: n_lines and n_removed.

    Lines end at "\\n" and must be equal to the letter. A text of fewer lines than
    a window is one window, compared with texts just like it. Windows of blank
    lines alone are left. The first occurrence is the one with the least doc_id
    (null ids last), then text digest, then position. A line is removed if any
    later occurrence covers it; a copy of it always stays at its first place.
    A text of which no line is left becomes empty; null stays null (no lines).
    Rows that agree in doc_id and text are one document and stay alike. An
    empty table gives none. Very long texts are taken whole. With counts, the columns
    n_lines and n_removed replace any so named; without, the columns stay those of docs.
    """
    starts = later_occurrences(docs, size).groupBy("id", "key").agg(F.collect_set("pos").alias("starts")).select(F.col("id").alias("cut_id"), F.col("key").alias("cut_key"), "starts")
    packed = docs.select(F.struct("*").alias("row"), order_id().alias("row_id"), text_key().alias("row_key"))
    joined = packed.join(starts.hint("shuffle_hash"), (F.col("row_id") == F.col("cut_id")) & (F.col("row_key") == F.col("cut_key")), "left")
    lines = F.split("row.text", "\n", -1)
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + size - 1)))
    kept = F.array_except(places, covered)
    cut = joined.select(
        "row",
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.when(F.col("starts").isNotNull(), kept).alias("kept"),
    )
    text = F.when(F.col("kept").isNotNull(), F.array_join(F.transform("kept", lambda i: F.get(lines, i)), "\n")).otherwise(F.col("row.text"))
    n_lines = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.col("n_lines"))
    removed = F.when(F.col("kept").isNotNull(), F.col("n_lines") - F.size("kept")).otherwise(F.lit(0))
    columns = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    if not counts:
        return cut.select(*columns)
    return cut.select(*columns, n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
