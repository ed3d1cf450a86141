r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only its
reply is trainable. A turn is written as ``<|role|>``, newline, text, ``<|end|>``, newline. Control
strings cannot come from data: in roles and texts a backslash is written ``\b`` and ``<`` is written
``\l``, in roles a newline ``\n``; reading back replaces ``\l`` and ``\n`` first and ``\b`` last.

Defined results: a null text or role counts as empty; a null conversation id is one conversation;
rows of equal turn go by role and text, repeated rows stay repeated turns, null turns come first.
A conversation that does not end with an assistant turn has one more example without a loss, so
that every turn is in the output. An empty table gives no examples. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))
    return F.replace(plain, F.lit("\\b"), F.lit("\\"))


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length), spans in code points of ``formatted``."""
    role = F.coalesce("role", F.lit(""))
    text = F.coalesce("text", F.lit(""))
    role_out = F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))
    rows = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            role.alias("role"),
            text.alias("text"),
            F.concat(F.lit("<|"), role_out, F.lit("|>\n")).alias("head"),
            escaped(text).alias("body"),
        ).alias("t"),
    )
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    last = F.size("turns") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("turns", i)["role"] == "assistant") | (i == last))
    target = F.get("turns", F.col("target"))
    written = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    trained = target["role"] == "assistant"
    return (
        talks.select("conv_id", "turns", F.posexplode(targets).alias("example", "target"))
        .withColumn("prefix", F.array_join(F.slice(written, F.lit(1), F.col("target")), ""))
        .select(
            "conv_id",
            "example",
            F.concat("prefix", target["head"], target["body"], F.lit(END)).alias("formatted"),
            F.when(trained, F.length("prefix") + F.length(target["head"])).alias("loss_start"),
            F.when(trained, F.length(target["body"])).alias("loss_length"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) parsed from a formatted example."""
    pieces = F.split(formatted, r"<\|end\|>\n")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "|>\n", 1)
        return F.struct(
            unescaped(F.substr(head, F.lit(3))).alias("role"),
            unescaped(F.substr(piece, F.length(head) + 4)).alias("text"),
        )

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example, unescaped; empty where nothing is trained."""
    return F.coalesce(unescaped(F.substr(formatted, start + 1, length)), F.lit(""))


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples."""
    loss = read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length"))
    per_talk = (
        examples.groupBy("conv_id")
        .agg(
            F.max_by("formatted", "example").alias("whole"),
            F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
            F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        )
        .withColumn("turns", read_turns(F.col("whole")))
        .withColumn("loss", F.array_join("losses.loss", ""))
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per_talk.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
