"""Chat formatting with Spark expressions only: sorted turn structs, merged same-role turns, one string per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, PART, END = "<turn>", "<text>", "<part>", "</turn>"  # all begin with "<", which escaped texts never hold
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\b`` and ``<`` becomes ``\l``; null becomes the empty text. ``unescape`` undoes it exactly."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One line per conversation: its id, ``formatted`` and ``loss_mask``, run lengths over ``formatted``: array of (skip, chars, loss).

    Turns go by (turn, role, text), nulls first. Adjacent turns of one role are merged into one block
    ``<turn>role<text>part<part>part</turn>``. Of each run, ``skip`` code points are marks and ``chars`` are a
    row's escaped text, which counts for the loss if it is the assistant's. Null roles
    and texts count as empty; a null conversation id is a conversation of its own; no rows, no lines. A conversation's
    string must fit a Spark value (2 GB); its turns meet in one row because that string is the result.
    """
    said = F.struct(F.col(turn).alias("turn"), escape(F.col(role)).alias("role"), escape(F.col(text)).alias("text"))
    grouped = turns.groupBy(F.col(conv).alias("conv")).agg(F.sort_array(F.collect_list(said)).alias("turns"))

    def head(x: Column, i: Column) -> Column:
        opened = F.concat(F.lit(TURN), x["role"], F.lit(TEXT))
        return F.when(i == 0, opened).when(F.get(F.col("turns"), i - 1)["role"] == x["role"], F.lit(PART)).otherwise(F.concat(F.lit(END), opened))

    marked = grouped.withColumn("parts", F.transform("turns", lambda x, i: F.struct(head(x, i).alias("head"), x["text"].alias("text"), (x["role"] == F.lit(LOSS_ROLE)).alias("loss"))))
    formatted = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"])), ""), F.lit(END))
    mask = F.transform("parts", lambda p: F.struct(F.char_length(p["head"]).alias("skip"), F.char_length(p["text"]).alias("chars"), p["loss"].alias("loss")))
    return marked.select(F.col("conv").alias(conv), formatted.alias("formatted"), mask.alias("loss_mask"))


def parse_chats(formatted: Column) -> Column:
    """The turns inside a formatted string: array of (role, text), one per original row."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")

    def rows(block: Column) -> Column:
        cut = F.instr(block, TEXT)
        role = unescape(F.substring(block, F.lit(len(TURN) + 1), cut - 1 - len(TURN)))
        parts = F.split(F.substring(block, cut + len(TEXT), F.char_length(block)), PART)
        return F.transform(parts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, rows))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the loss runs of ``mask``, sliced from ``formatted`` by code points, in order.

    Slices are taken from the string in four bytes a code point, so that each costs its own length only. Escapes never
    cross runs, so the slices are unescaped together."""
    wide = F.encode(formatted, "UTF-32")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<binary>").alias("out"))

    def step(seen: Column, run: Column) -> Column:
        at = seen["at"] + run["skip"]
        piece = F.substring(wide, 4 * at + 1, 4 * run["chars"])
        return F.struct((at + run["chars"]).alias("at"), F.when(run["loss"], F.array_append(seen["out"], piece)).otherwise(seen["out"]).alias("out"))

    pieces = F.aggregate(mask, start, step)["out"]
    mark = F.unhex(F.lit("0000FEFF"))  # says the byte order, and is not part of the text
    return unescape(F.array_join(F.transform(pieces, lambda p: F.decode(F.concat(mark, p), "UTF-32")), ""))


def read_back(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what stands in the formatted strings: turns, and the unescaped text under the loss mask."""
    parsed = chats.withColumns({"said": parse_chats(F.col("formatted")), "loss": under_mask(F.col("formatted"), F.col("loss_mask"))})
    everything = F.array_join(F.transform("said", lambda s: F.concat(s["role"], F.lit("\n"), s["text"], F.lit("\n"))), "")
    return parsed.select(
        conv, F.size("said").cast("long").alias("n_turns"), F.sha2(everything, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
