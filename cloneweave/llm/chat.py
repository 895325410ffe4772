"""Chat formatting with a grammar round trip, in SQL expressions only.

    conversation := <s> turn*
    turn         := [INST] role [/INST]text</s>

with one space inside the role's marks.  A turn is rendered as it is, reparsed
by the grammar (a text or role that holds a control string doesn't parse) and
compared to its source; a turn that isn't recovered is escaped: every control
string in it, with or without backslashes after its first character, gets one
backslash more there.  The parser takes one off again, so escaped turns are
recovered whatever they hold.  The finished conversation is parsed once more
and must equal its source.

Defined results: null texts and roles count as empty; null turns come first;
rows of equal turns stand by role, then text; repeated rows are repeated
turns; rows of null conv_id form one conversation; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST] ", " [/INST]"
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
TURN = r"(?s)^\[INST\] (.*?) \[/INST\](.*)$"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(EOS))


def parse(formatted: Column) -> Column:
    """Array of struct(role, text) of a formatted conversation."""
    pieces = F.split(F.substr(formatted, F.lit(len(BOS) + 1)), EOS)
    inner = F.slice(pieces, F.lit(1), F.greatest(F.lit(0), F.size(pieces) - 1))
    return F.transform(inner, lambda p: F.struct(unescape(F.regexp_extract(p, TURN, 1)).alias("role"), unescape(F.regexp_extract(p, TURN, 2)).alias("text")))


def _recovered(role: Column, text: Column) -> Column:
    """Whether the turn, rendered as it is, parses into itself."""
    piece = F.concat(F.lit(OPEN), role, F.lit(CLOSE), text)
    lawful = ~(role.rlike(CONTROL) | text.rlike(CONTROL))
    return lawful & (F.regexp_extract(piece, TURN, 1) == role) & (F.regexp_extract(piece, TURN, 2) == text)


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (array of start and length, in characters of formatted)."""
    src = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ok = _recovered(F.col("role"), F.col("text"))
    src = src.withColumn("r", F.when(ok, F.col("role")).otherwise(escape(F.col("role")))).withColumn("t", F.when(ok, F.col("text")).otherwise(escape(F.col("text"))))
    src = src.withColumn("piece", render(F.col("r"), F.col("t")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    src = src.withColumn("n", F.row_number().over(order)).withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - len(EOS) - F.length("t") + len(BOS)
    src = src.withColumn("span", F.when(F.col("role") == loss_role, F.struct(start.cast("int").alias("start"), F.length("t").alias("length"))))
    got = src.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "role", "text", "piece", "span"))).alias("turns"))
    got = got.withColumn("formatted", F.concat(F.lit(BOS), F.array_join(F.col("turns.piece"), "")))
    same = parse(F.col("formatted")) == F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return got.select("conv_id", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation was not recovered")).cast("string")).alias("formatted"), F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its loss spans hold, read back by the parser."""
    turns = parse(F.col("formatted"))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    got = formatted.withColumn("_turns", turns).withColumn("_loss", loss)
    joined = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return got.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
