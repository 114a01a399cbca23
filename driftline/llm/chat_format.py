"""Chat formatting in Spark expressions: turns in order, adjacent turns of a role in one block, a loss mask beside it.

A conversation becomes ``<s>role\\ntext<sep>text</s><s>role\\ntext</s>``: a block for each run of turns of one role, its
texts apart by ``<sep>``. Inside roles and texts a backslash is doubled, and a control string (marks of this or other
templates) gets a backslash after its first character, so no mark can come from a text; a line break in a role gets a
backslash before it. Taking every backslash away and keeping what follows it gives the text back.

The loss mask lists [start, end) in code points of the output, one entry for each turn of the trained role, without marks.

How. The turns of a conversation are collected as structs and sorted; the places where a role differs from the one before
cut the sorted array into slices, which are the blocks; texts of a block are joined, and blocks are joined. Nothing is
appended to an array in a loop, so the work is linear in the text, and about n * sqrt(n) in the number n of turns for the
running lengths that spans need.

Odd rows: turns sort by turn (nulls first), role and text, so ties have one order and repeated rows stay; a null text or
role is empty; rows with a null conversation form one conversation; an empty table gives an empty result. All turns of a
conversation meet in one task, since its output is one string; conversations spread over tasks by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP, APART = "<s>", "</s>", "<sep>"
CONTROL = (START, STOP, APART, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def escape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in control:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def format_conversations(turns: DataFrame, trained_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and end in code points)."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    # Each column that a function looks things up in is used more than once, so that Catalyst keeps it a column.
    changes = "(i = 0 OR t[i].role <> t[greatest(i - 1, 0)].role)"
    joined = joined.withColumn("bodies", F.transform("t", lambda x: escape(x["text"])))
    joined = joined.withColumn("heads", F.transform("t", lambda x, i: F.when((i == 0) | (x["role"] != F.get("t", F.greatest(i - 1, F.lit(0)))["role"]), _head(x["role"])).otherwise("")))
    joined = joined.withColumn("cuts", F.expr(f"filter(sequence(0, size(t) - 1), i -> {changes})"))
    ends = F.transform("cuts", lambda _, j: F.coalesce(F.get("cuts", j + 1), F.size("t")))
    blocks = F.zip_with("cuts", ends, lambda a, b: F.concat(F.get("heads", a), F.array_join(F.slice("bodies", a + 1, b - a), APART)))
    # Where turns end: sums within runs of about sqrt(n) turns, added to the sum of the runs before.
    marks = f"CASE WHEN NOT {changes} THEN {len(APART)} WHEN i = 0 THEN char_length(heads[i]) ELSE {len(STOP)} + char_length(heads[i]) END"
    joined = joined.withColumn("formatted", F.concat(F.array_join(blocks, STOP), F.lit(STOP))).withColumn("sizes", F.expr(f"transform(bodies, (x, i) -> bigint({marks} + char_length(x)))"))
    joined = joined.withColumn("run", F.ceil(F.sqrt(F.size("t"))).cast("int"))
    joined = joined.withColumn("runs", F.expr("transform(sequence(1, size(sizes), run), s -> aggregate(slice(sizes, s, run), 0L, (a, x) -> a + x))"))
    joined = joined.withColumn("before", F.expr("transform(runs, (_, j) -> aggregate(slice(runs, 1, j), 0L, (a, x) -> a + x))"))
    joined = joined.withColumn("stops", F.expr("transform(sizes, (_, i) -> before[least(i div run, size(before) - 1)] + aggregate(slice(sizes, int(i div run) * run + 1, i % run + 1), 0L, (a, x) -> a + x))"))
    trained = F.filter(F.expr("sequence(0, size(t) - 1)"), lambda i: F.get("t", i)["role"] == trained_role)
    spans = F.transform(trained, lambda i: F.struct((F.get("stops", i) - F.char_length(F.get("bodies", i))).alias("start"), F.get("stops", i).alias("end")))
    return joined.select("conv_id", "formatted", spans.alias("loss_spans"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))


def read_turns(formatted: Column) -> Column:
    """The turns of an output string: array of role and text, as they went in."""
    blocks = F.filter(F.split(formatted, STOP), lambda b: b != "")
    block = r"(?s)^<s>((?:[^\\\n]|\\.)*)\n(.*)$"

    def turns_of(b: Column) -> Column:
        role = unescape(F.regexp_extract(b, block, 1))
        return F.transform(F.split(F.regexp_extract(b, block, 2), APART), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def read_masked(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def digests(outputs: DataFrame) -> DataFrame:
    """What a reader gets back from the output strings and masks."""
    read = outputs.withColumn("turns", read_turns(F.col("formatted"))).withColumn("masked", F.array_join(read_masked(F.col("formatted"), F.col("loss_spans")), ""))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
