"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; neighbours of one
role are merged into a block; blocks are concatenated under a template of
control strings. Control strings inside texts are escaped, reversibly, so that
the output can be read back. The loss mask marks assistants' texts and nothing
else: no role line, separator or end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END, NEWLINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|im_nl|>"


def escape(text: Column) -> Column:
    """No "<|" is left in the result: a backslash parts it, and backslashes double."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, pieces, for each conversation of turns (conv_id, turn, role, text).

    A block is START, role, newline, its texts with SEPARATOR between, END,
    newline. pieces: array of (piece, loss) whose pieces join up to formatted; loss
    marks the pieces to be trained on, escaped as in formatted. Null texts and
    roles are empty. Turns are in order of turn (null first), then role, then
    text; repeated rows are turns of their own. Rows with a null conv_id are one
    conversation. An empty table gives no rows.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    tidy = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    sorted_turns = tidy.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    places = F.sequence(F.lit(0), F.size("t") - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    bounded = sorted_turns.withColumn("starts", starts).withColumn("ends", F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("t"))))

    def block(bounds: Column) -> Column:
        own = F.slice("t", bounds["starts"] + 1, bounds["ends"] - bounds["starts"])
        return F.struct(F.get("t", bounds["starts"])["role"].alias("role"), F.transform(own, lambda x: x["text"]).alias("texts"))

    def pieces(b: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escape(b["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
        trained = b["role"] == trained_role

        def piece(x: Column, loss: Column) -> Column:
            return F.struct(x.alias("piece"), loss.alias("loss"))

        body = F.flatten(F.transform(b["texts"], lambda x, i: F.array(piece(F.when(i > 0, F.lit(SEPARATOR)).otherwise(head), F.lit(False)), piece(escape(x), trained))))
        return F.concat(body, F.array(piece(F.lit(END + "\n"), F.lit(False))))

    blocks = bounded.select("conv_id", F.transform(F.arrays_zip("starts", "ends"), block).alias("blocks"))
    cut = blocks.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    return cut.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "pieces")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns as they were, from a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        role = unescape(F.replace(F.substring(head, len(START) + 1, F.length(head)), F.lit(NEWLINE), F.lit("\n")))
        body = F.substring(b, F.length(head) + 2, F.length(b))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(pieces: str) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    own = F.filter(pieces, lambda p: p["loss"])
    return F.array_join(F.transform(own, lambda p: unescape(p["piece"])), "")


def digest_chats(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as digests."""
    back = chats.select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss_text("pieces").alias("loss"), F.length("formatted").alias("n"), F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
    )
