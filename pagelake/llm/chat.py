"""Chat formatting in Spark expressions only: sort turn structs, merge, concatenate, read back.

A conversation becomes
    <|role|>NAME\\nTEXT<|end|>\\n ...
with one block for each run of turns of one role; the texts of a run are parted by <|turn|>. A line
end in a name is written [n. In names and texts, every "<" and "[" gets a backslash behind it. No control string, of this template or
of one that writes <s>, </s>, [INST], [/INST] or <<SYS>>, can then come from a text, and taking the
backslash away again behind each "<" and "[" gives the text back, whatever it held.

Nulls: a null text or role is empty; a null turn sorts first; a row of a null conversation is a
conversation of its own, as nothing says that it belongs with others. Turns of one number are sorted
by role, then text; a repeated row is a turn of its own. An empty table gives no rows. Texts and
conversations of any length are taken whole, in time in proportion; a conversation is one output row,
as its text is one value. Only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm import folds

OPEN, SHUT, END, NEXT = "<|role|>", "\n", "<|end|>\n", "<|turn|>"
LEARN = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\"), F.lit("<")), F.lit("[\\"), F.lit("["))


def format_turns(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, formatted, mask): mask holds (start, length) in code points of what is learned."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = rows.select(F.col(conversation).alias("c"), one.alias("t"))
    sorted_ = turns.where("c is not null").groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("t"))
    sorted_ = sorted_.unionByName(turns.where("c is null").select("c", F.array("t").alias("t")))

    def piece(t: Column, i: Column) -> Column:
        """What a turn adds: a block's head or a separator, its text, and the end of its block."""
        turns = F.col("t")
        first = (i == 0) | (F.get(turns, i - 1)["role"] != t["role"])
        last = (i == F.size(turns) - 1) | (F.get(turns, i + 1)["role"] != t["role"])
        return F.struct(
            F.when(first, F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("[n")), F.lit(SHUT))).otherwise(F.lit(NEXT)).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(last, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            (t["role"] == LEARN).alias("learn"),
        )

    pieces = sorted_.select("c", F.transform("t", piece).alias("p"))
    formatted = F.concat_ws("", F.flatten(F.transform("p", lambda p: F.array(p["head"], p["body"], p["tail"]))))

    sizes = "transform(p, x -> cast(length(x.head) + length(x.body) + length(x.tail) as bigint))"
    spans = "transform(filter(transform(p, (x, j) -> struct(cast(at[j] + length(x.head) as int) as start, length(x.body) as length, x.learn as learn)), x -> x.learn), x -> struct(x.start as start, x.length as length))"
    return pieces.select(F.col("c").alias(conversation), formatted.alias("formatted"), F.expr(folds.let(folds.before(sizes), "at", spans)).alias("mask"))


def read_turns(formatted: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and turns, an array of (role, text), from the formatted text alone."""
    # every block starts with OPEN, so what stands before the first is empty
    blocks = F.filter(F.split("formatted", r"<\|role\|>"), lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        at = F.locate(SHUT, block)
        role = unescape(F.replace(F.substring(block, 1, at - 1), F.lit("[n"), F.lit("\n")))
        body = F.substring(block, at + 1, F.length(block) - at - len(END))
        return F.transform(F.split(body, r"<\|turn\|>"), lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    return formatted.select(*keep, F.flatten(F.transform(blocks, turns)).alias("turns"))


def learned(formatted: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and learned: the unescaped texts under the mask, in order."""
    cut = F.expr(folds.let(folds.blocks("formatted"), "bs", f"transform(mask, x -> {folds.cut('bs', 'x.start', 'x.start + x.length')})"))
    return formatted.select(*keep, F.transform(cut, unescape).alias("learned"))


def digests(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Counts and digests of every conversation, all read back from the formatted text."""
    done = format_turns(rows, conversation, turn, role, text)
    back = learned(read_turns(done, [conversation, "formatted", "mask"]), [conversation, "formatted", "turns"])
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("learned", "")
    return back.select(
        conversation,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
