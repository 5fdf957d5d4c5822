"""Chat formatting with Spark expressions only.

A conversation's turns are sorted, adjacent turns of one role are merged into
a block under one header, and everything is concatenated::

    ### user:
    text</turn>
    ### assistant:
    text</turn>
    more of the same role</turn>

Control strings inside texts are escaped so that no text can hold ``</turn>``
or ``### ``, and unescaping gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, HEAD = "</turn>", "### "
#: Turns whose lengths are added one by one.
BLOCK = 128
_ENDED, _HEADED = "<\\e/turn>", "#\\h## "


def escape(text: Column) -> Column:
    """Doubles backslashes, then breaks control strings with a single one."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit(END), F.lit(_ENDED)), F.lit(HEAD), F.lit(_HEADED))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit(_HEADED), F.lit(HEAD)), F.lit(_ENDED), F.lit(END))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _role_name(role: Column) -> Column:
    """Plain roles as they are, any other as ~ and hex digits."""
    return F.when(role.rlike("^[a-z_]+$"), role).otherwise(F.concat(F.lit("~"), F.hex(role)))


def _role_of(name: Column) -> Column:
    return F.when(name.startswith("~"), F.decode(F.unhex(F.substr(name, F.lit(2))), "utf-8")).otherwise(name)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): the text and its loss mask.

    ``loss`` lists (start, length) of every text of ``loss_role`` in code
    points of ``formatted``.  Turns are sorted by turn, then role and text;
    null texts and roles count as empty, null turns come first, rows with a
    null conv_id form one conversation.  Repeated rows stay.  The rows of one
    conversation make one string, so they are gathered in one row.
    """
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    role = lambda i: F.element_at("turns", i)["role"]
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.when(i == 1, True).otherwise(role(i) != role(F.greatest(i - 1, F.lit(1)))))
    cut = sorted_turns.withColumn("starts", starts)
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            role(s).alias("role"),
            F.transform(F.slice("turns", s, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - s), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    merged = cut.select("conv_id", blocks.alias("blocks"))
    heads = merged.select("conv_id", F.transform("blocks", lambda b: F.struct(F.concat(F.lit(HEAD), _role_name(b["role"]), F.lit(":\n")).alias("head"), b["texts"].alias("texts"), (b["role"] == loss_role).alias("loss"))).alias("blocks"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(F.transform(b["texts"], lambda t: F.concat(t, F.lit(END + "\n"))), ""))), "")
    # Lengths of the runs before, in and after each text, in order.
    runs = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"], lambda t, i: F.struct(F.when(i == 0, F.length(b["head"])).otherwise(0).alias("skip"), F.length(t).alias("n"), b["loss"].alias("loss"))
            ),
        )
    )
    out = heads.select("conv_id", formatted.alias("formatted"), runs.alias("runs"))
    return out.select("conv_id", "formatted", _spans(F.col("runs")).alias("loss"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often a nested lambda uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, n: acc + n)


def _spans(runs: Column) -> Column:
    """(start, length) of the texts under the loss; sums of blocks keep the cost near linear in the turns."""

    def place(lengths, starts):
        at = lambda i: F.get(starts, F.floor(i / BLOCK).cast("int")) + _sum(F.slice(lengths, i - i % BLOCK + 1, i % BLOCK))
        spans = F.transform(runs, lambda r, i: F.when(r["loss"], F.struct((at(i) + r["skip"]).alias("start"), r["n"].alias("length"))))
        return F.array_compact(spans)

    def blocks(lengths):
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda c: _sum(F.slice(lengths, c * BLOCK + 1, F.lit(BLOCK))))
        starts = lambda s: F.transform(s, lambda _, c: _sum(F.slice(s, F.lit(1), c)))
        return _let(sums, lambda s: _let(starts(s), lambda t: place(lengths, t)))

    return _let(F.transform(runs, lambda r: r["skip"] + r["n"] + (len(END) + 1)), blocks)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text), read back from formatted texts.

    ``turns`` lists (role, text) of every turn that was formatted, merged or
    not; ``loss_text`` is all text under the mask, unescaped.
    """
    blocks = F.split("formatted", HEAD)
    blocks = F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turns(block):
        name = F.substring_index(block, ":\n", 1)
        texts = F.split(F.substr(block, F.length(name) + 3), END + "\n")
        return F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda t: F.struct(_role_of(name).alias("role"), unescape(t).alias("text")))

    return formatted.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform(blocks, turns)).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "").alias("loss_text"),
    )
