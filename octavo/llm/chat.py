"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions alone.

Prefix sums of the turns' tokens choose the spans: a window takes the turns that begin within one stride,
a turn longer than the stride has a window of its own. Every window begins with the conversation's system
turn (if its first turn is one) and the last turns before it, up to ``history`` tokens. Repeated turns are
outside the loss mask; each assistant text is under it once.

Template: ``### role: text</turn>`` and a line feed for each turn. Inside roles and texts ``\\`` is written
``\\b``, ``<`` is ``\\l`` and ``#`` is ``\\h`` (in roles also ``:`` is ``\\c``), so no marker can occur there, and
every backslash is followed by its letter, which makes the way back unique.

A window has at most ``budget`` tokens unless one turn alone (with what is repeated) has more: turns are
never cut. Null texts and roles are empty. Turns come in order of turn, role, text; equal rows are turns of
their own. A null conversation id is a conversation. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octavo.llm.shared import keep

#: Tokens of a window, and of the history repeated at its head.
BUDGET, HISTORY = 1024, 192
#: Tokens of a turn's markers, added to the words of its text.
MARKS = 4
END = "</turn>\n"


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns in order (n from 1) with their tokens; ``sys`` is the tokens of a leading system turn, else 0."""
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    w = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("tokens", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + MARKS)
    lead = (F.col("n") == 1) & (F.col("role") == "system")
    return rows.withColumn("sys", F.first(F.when(lead, F.col("tokens")).otherwise(F.lit(0))).over(w))


def assigned(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """For each turn its window (from 0), and ``at``: the tokens before it, a leading system turn not counted."""
    own = Window.partitionBy("conv").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lead = (F.col("n") == 1) & (F.col("sys") > 0)
    rows = rows.withColumn("stride", F.greatest(F.expr(f"({budget} - {history} - sys) div 2"), F.lit(1))).withColumn("lead", lead)
    rows = rows.withColumn("solo", F.when(~F.col("lead") & (F.col("tokens") > F.col("stride")), 1).otherwise(0))
    counted = F.when(F.col("lead"), 0).otherwise(F.col("tokens"))
    rows = rows.withColumn("at", F.sum(counted).over(own) - counted).withColumn("segment", 2 * F.sum("solo").over(own) - F.col("solo"))
    inside = F.col("at") - F.min("at").over(Window.partitionBy("conv", "segment"))
    rows = rows.withColumn("span", F.floor(inside / F.col("stride")))
    return rows.withColumn("window", F.dense_rank().over(Window.partitionBy("conv").orderBy("segment", "span")) - 1).drop("segment", "span", "solo", "stride")


def windows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row for each window: conv, window, formatted, n_repeated (turns at its head that are not new), n_tokens,
    and mask: spans (start from 0 and length, in code points of formatted) that count for the loss."""
    rows = keep(assigned(turns(conversations, conv, turn, role, text), budget, history), "turns")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    heads = rows.groupBy("conv", "window").agg(F.min("at").alias("start"), F.min("n").alias("first")).where("first > 1")
    heads = heads.select(F.col("conv").alias("w_conv"), F.col("window").alias("w"), "start", "first")
    # Earlier turns within the history: both sides are binned by tokens, so a turn meets the windows of two bins only.
    bins = heads.withColumn("bin", F.explode(F.array(F.expr(f"start div {history}"), F.expr(f"start div {history} - 1"))))
    earlier = rows.where("not lead").withColumn("t_bin", F.expr(f"at div {history}"))
    recalled = earlier.join(bins, same("conv", "w_conv") & (F.col("t_bin") == F.col("bin")) & (F.col("n") < F.col("first")) & (F.col("start") - F.col("at") <= history))
    led = rows.where("lead").join(heads, same("conv", "w_conv"))
    part = lambda df, w, new: df.select("conv", F.col(w).alias("window"), F.lit(new).alias("new"), "n", "tokens", "role", "text")
    pieces = part(rows, "window", True).unionByName(part(recalled, "w", False)).unionByName(part(led, "w", False))
    head = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(": "))
    pieces = pieces.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv", "window").orderBy("new", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.length("piece")).over(order) - F.length("piece") + F.length("head")
    pieces = pieces.withColumn("span", F.when(F.col("new") & (F.col("role") == "assistant"), F.struct(start.alias("start"), F.length("body").cast("long").alias("len"))))
    by = pieces.groupBy("conv", "window").agg(F.sort_array(F.collect_list(F.struct("new", "n", "piece", "span"))).alias("p"), F.count_if(~F.col("new")).alias("n_repeated"), F.sum("tokens").alias("n_tokens"))
    mask = F.filter(F.transform("p", lambda x: x["span"]), lambda s: s.isNotNull())
    return by.select(F.col("conv").alias(conv), "window", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), "n_repeated", "n_tokens", mask.alias("mask"))


def parsed(formatted: DataFrame) -> DataFrame:
    """Windows with what can be read from them: turns (role, text; without repeats) and loss (the texts under the mask)."""
    parts = F.split("formatted", END)
    parts = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, ": ", 1)
        return F.struct(unescape(F.replace(F.substr(role, F.lit(5)), F.lit("\\c"), F.lit(":"))).alias("role"), unescape(F.substr(p, F.length(role) + 3)).alias("text"))

    loss = F.transform("mask", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["len"].cast("int"))))
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("loss", loss)


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its windows: turns, their digest, the loss text's size and digest, and the size of the whole."""
    read = parsed(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select(conv, "window", F.size("turns").alias("n"), said.alias("said"), F.array_join("loss", "").alias("lost"), F.length("formatted").alias("chars"))
    by = read.groupBy(conv).agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "said", "lost"))).alias("w"))
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return by.select(conv, "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("lost")).cast("long").alias("loss_chars"), F.sha2(joined("lost"), 256).alias("loss_sha256"), "formatted_chars")
