"""Chat formatting by prefix-target expansion, and reading the examples back.

A turn is written ``### <role>: <text> </turn>`` and a newline.  Inside roles
and texts the characters of these marks are escaped, so that no text can end a
turn or begin one, and unescaping restores it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ": ", " </turn>\n"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escaped(c: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in escapes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def expand(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", reply_role: str = "assistant") -> DataFrame:
    """One example per reply: all preceding turns as context, only that reply trainable.

    Returns conv_id, example_no (the reply's position, from 1), example,
    loss_start and loss_end (code points; the reply's escaped text) and n_turns.
    Turns after the last reply, or of a conversation without one, come in a last
    example with an empty span (loss_start null).  Turns are ordered by (turn,
    role, text), so ties and repeated rows have one order; null turns come
    first; null texts and roles count as empty; rows with a null conv_id form
    one conversation.  Empty tables give no rows, other columns are ignored."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    convs = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    head = lambda t: F.concat(F.lit(HEAD), escaped(t["role"], ROLE_ESCAPES), F.lit(COLON))
    convs = convs.withColumn("n_turns", F.size("turns").cast("long"))
    convs = convs.withColumn("written", F.transform("turns", lambda t: F.concat(head(t), escaped(t["text"]), F.lit(END))))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == reply_role) | (i == F.size("turns")))
    rows = convs.select("conv_id", "n_turns", "turns", "written", F.explode(ends).alias("example_no"))
    last = F.element_at("turns", F.col("example_no"))
    before = joined(F.slice("written", F.lit(1), F.col("example_no") - 1))
    rows = rows.withColumn("context", before).withColumn("start", F.length("context") + F.length(head(last)))
    reply = last["role"] == reply_role
    return rows.select(
        "conv_id", "example_no", F.concat("context", F.element_at("written", F.col("example_no"))).alias("example"),
        F.when(reply, F.col("start")).alias("loss_start"),
        F.when(reply, F.col("start") + F.length(escaped(last["text"]))).alias("loss_end"),
        F.col("example_no").cast("long").alias("n_turns"),
    )


def parse(examples: DataFrame) -> DataFrame:
    """Read examples back: adds turns (role and text, unescaped) and loss_text.

    An example without a loss span has an empty loss_text; columns beside those of ``expand`` stay; an empty table gives no rows."""
    pieces = F.split("example", r" </turn>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        at = F.instr(p, COLON)
        return F.struct(
            unescaped(F.substring(p, F.lit(len(HEAD) + 1), at - len(HEAD) - 1), ROLE_ESCAPES).alias("role"),
            unescaped(F.substring(p, at + len(COLON), F.length(p))).alias("text"),
        )

    loss = F.when(F.col("loss_start").isNotNull(), unescaped(F.substring(F.col("example"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    return examples.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", loss)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples.

    Null ids are one conversation, as in ``expand``; one without a reply has no loss (0 characters, the digest of nothing); an empty table gives no rows."""
    said = F.sha2(joined(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256)
    rows = parse(examples).select("conv_id", "example_no", F.size("turns").cast("long").alias("n"), said.alias("said"), F.coalesce("loss_text", F.lit("")).alias("loss"), F.length("example").cast("long").alias("chars"))
    return rows.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max_by("said", "example_no").alias("turns_sha256"), F.sum(F.length("loss")).alias("loss_chars"),
        F.sha2(joined(F.transform(F.array_sort(F.collect_list(F.struct("example_no", "loss"))), lambda x: x["loss"])), 256).alias("loss_sha256"),
        F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"),
    )
