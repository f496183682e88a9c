"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are
context, and only that reply is trainable. Turns after the last assistant turn
form one more example without a trainable part, so that nothing is lost.

A turn is written as START role SEP text END. Texts and roles are escaped before:
a backslash is doubled, and ESCAPE goes behind the first character of each control
string, so a control string in the output is always one of the template.

Defined results: a null text or role is empty; turns are ordered by turn, nulls
first, then role and text, so ties and repeated rows all stay; a null conv_id is a
conversation; an empty table gives no example; further columns are not read.
Memory is bounded by one conversation, which is the unit of an example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings and those of other common templates.
START = "<|im_start|>"
SEP = "<|im_sep|>"
END = "<|im_end|>"
CONTROLS = [START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ESCAPE = "\\_"


def _pattern(text: str) -> str:
    return "".join("\\" + c if c in "\\|[]<>/$." else c for c in text)


def escape(text: Column) -> Column:
    """Break every control string in a text, reversibly."""
    tails = "|".join(f"(?<={_pattern(c[0])})(?={_pattern(c[1:])})" for c in CONTROLS)
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, tails, r"\\_")


def unescape(text: Column) -> Column:
    """The inverse of escape."""
    return F.regexp_replace(text, r"\\(\\)|\\_", "$1")


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (from 0), target_turn (place of the trained turn
    from 1, null if none), n_turns in the example, formatted, and loss_start and loss_end, the code points of
    formatted that are trainable (both null if none)."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("one"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    written = talks.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"]).alias("roles"),
        F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
    )
    places = F.sequence(F.lit(1), F.size("roles"))
    targets = F.filter(places, lambda i: F.element_at("roles", i) == target_role)
    last = F.element_at("roles", -1)
    ends = F.when(last == target_role, targets).otherwise(F.concat(targets, F.array(F.size("roles"))))
    spread = written.select("conv_id", "roles", "heads", "bodies", F.posexplode(ends).alias("example", "n_turns"))
    whole = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END)))
    trained = F.element_at("roles", F.col("n_turns")) == target_role
    cut = spread.select(
        "conv_id",
        "example",
        "n_turns",
        trained.alias("trained"),
        F.array_join(F.slice(whole, F.lit(1), F.col("n_turns") - 1), "").alias("before"),
        F.element_at("heads", F.col("n_turns")).alias("head"),
        F.element_at("bodies", F.col("n_turns")).alias("body"),
    )
    start = F.length("before") + F.length("head")
    return cut.select(
        "conv_id",
        F.col("example").cast("int").alias("example"),
        F.when(F.col("trained"), F.col("n_turns")).alias("target_turn"),
        F.col("n_turns").cast("int").alias("n_turns"),
        F.concat("before", "head", "body", F.lit(END)).alias("formatted"),
        F.when(F.col("trained"), start).alias("loss_start"),
        F.when(F.col("trained"), start + F.length("body")).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    parts = F.filter(F.split(formatted, _pattern(END)), lambda p: p != "")
    bare = F.transform(parts, lambda p: F.split(F.substring(p, len(START) + 1, 1 << 30), _pattern(SEP), 2))
    return F.transform(bare, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold, read back from them."""
    loss = unescape(F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)"))
    per = examples.withColumn("loss", F.coalesce(loss, F.lit(""))).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    turns = per.withColumn("back", read_turns(F.col("longest")))
    flat = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
