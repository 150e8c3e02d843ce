"""Quotation linking: nested quotes are parsed, linked to the messages they quote, and taken out.

A line's quote level is the number of ">" before its text. A passage is a run of lines of
one level above 0. Passages, their paragraphs (between blank lines) and their single lines are normalised (lower case,
single spaces) and hashed. A message's own text, its unquoted runs, paragraphs and lines are hashed alike; the earliest message of
each hash, in each conversation and over all, is its original. A quote links to the original in its
own conversation if that is of an earlier turn, else to the earliest in another conversation; the latter only as
a whole passage or paragraph of ``FAR_WORDS`` words or more, as common short lines join nothing. Conversations have no order but their
id: of several, the smallest id counts as the earliest.

A message's parent is the original of its lowest-level quote, of the latest turn (passages before paragraphs before
lines, its own conversation before others); without one the nearest earlier turn. Replies are ordered
by (parent's turn, turn), so that a parent stands before its replies.

Null texts are empty. Null conversations are one conversation, null turns come first and are never
parents. Repeated rows repeat their result (with the next position). Other columns are left out. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import materialize

_MARK = r"^[ \t]*((?:>[ \t]?)*)"
#: Turns of a conversation that are numbered in one task.
_RUN = 1000
#: Words of a passage that links conversations.
FAR_WORDS = 5


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """Add ``passages``: runs of lines of one level, as (level, lines), from ``text``."""
    line = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARK, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARK, "").alias("body")),
    )
    parsed = messages.withColumn("__lines", line)
    starts = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: F.when(i > 0, F.col("__lines")[i]["level"] != F.col("__lines")[i - 1]["level"]).otherwise(True))
    parsed = parsed.withColumn("__starts", starts)

    def run(start, k):
        end = F.coalesce(F.try_element_at("__starts", k + 2), F.size("__lines"))
        lines = F.slice("__lines", start + 1, end - start)
        return F.struct(F.col("__lines")[start]["level"].alias("level"), F.transform(lines, lambda x: x["body"]).alias("lines"))

    return parsed.withColumn("passages", F.transform("__starts", run)).drop("__lines", "__starts")


def _units(bodies: Column, part: int) -> Column:
    """(part, hash, words) of the non-empty normalised texts of an array."""
    texts = F.filter(F.transform(bodies, _normal), lambda t: t != "")
    return F.transform(texts, lambda t: F.struct(F.lit(part).alias("part"), F.md5(t).alias("hash"), F.size(F.split(t, " ")).alias("words")))


def _paragraphs(whole: Column) -> Column:
    return F.split(whole, r"\n[\x20\x09-\x0D]*\n", -1)


def _parts(lines: Column) -> Column:
    """The units of some lines: all of them, their paragraphs, and each one."""
    whole = F.array_join(lines, "\n")
    return F.concat(_units(F.array(whole), 0), _units(_paragraphs(whole), 1), _units(lines, 2))


def _hashes(clean: Column, own: Column) -> Column:
    """Hashes of a message's own text and of the units of its runs; texts that are the same are normalised once."""
    whole = F.transform(own, lambda p: F.array_join(p["lines"], "\n"))
    texts = F.array_distinct(F.concat(F.array(clean), whole, F.flatten(F.transform(whole, _paragraphs)), F.flatten(F.transform(own, lambda p: p["lines"]))))
    return F.array_distinct(F.transform(F.filter(F.transform(texts, _normal), lambda t: t != ""), lambda t: F.md5(t)))


def link(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, clean_text, n_quotes, max_level, n_linked, parent_conv_id, parent_turn, position."""
    rows = messages.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = parse(rows.withColumn("key", F.md5(F.coalesce("text", F.lit("")))))
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    own = F.filter("passages", lambda p: p["level"] == 0)
    own_lines = F.flatten(F.transform(own, lambda p: p["lines"]))
    clean = F.trim(F.regexp_replace(F.array_join(own_lines, "\n"), r"^\n+|\n+$", ""))
    rows = rows.withColumns({"clean_text": clean, "n_quotes": F.size(quoted), "max_level": F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)), "__quoted": quoted})
    rows = rows.withColumn("__own", _hashes(F.col("clean_text"), own)).withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows.drop("passages", "text"))  # parsed once
    originals = rows.select("conv_id", "turn", F.explode("__own").alias("hash")).where("turn is not null")
    inside = materialize(originals.groupBy("hash", "conv_id").agg(F.min("turn").alias("in_turn")))
    # the two first conversations of a hash: one of them is another than the quote's own
    pair = F.struct("conv_id", F.col("in_turn").alias("turn"))
    first = inside.groupBy("hash").agg(F.min(pair).alias("first"))
    second = inside.join(first, "hash").where(~F.col("conv_id").eqNullSafe(F.col("first.conv_id"))).groupBy("hash").agg(F.min(pair).alias("second"))
    anywhere = first.join(second, "hash", "left")

    quotes = rows.where("n_quotes > 0").select("conv_id", "turn", "__row", F.posexplode("__quoted").alias("at", "quote"))
    quotes = quotes.select("conv_id", "turn", "__row", "at", F.col("quote.level").alias("level"), F.explode(F.array_distinct(_parts(F.col("quote.lines")))).alias("unit")).select("*", "unit.part", "unit.hash", "unit.words").drop("unit")
    here = inside.select(F.col("hash").alias("h1"), F.col("conv_id").alias("c1"), "in_turn")
    quotes = quotes.join(here, (F.col("hash") == F.col("h1")) & F.col("conv_id").eqNullSafe(F.col("c1")), "left")
    quotes = quotes.join(anywhere.select(F.col("hash").alias("h2"), "first", "second"), F.col("hash") == F.col("h2"), "left")
    near = F.coalesce(F.col("in_turn") < F.col("turn"), F.lit(False))
    other = F.when(F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.col("second")).otherwise(F.col("first"))
    far = other.isNotNull() & (F.col("part") < 2) & (F.col("words") >= FAR_WORDS)
    quotes = quotes.where(near | far)
    target = F.when(near, F.struct("conv_id", F.col("in_turn").alias("turn"))).otherwise(other)
    rank = F.struct(F.when(near, 0).otherwise(1).alias("far"), "level", "part", (-target["turn"]).alias("late"), target.alias("target"))
    linked = quotes.groupBy("__row").agg(F.min(rank).alias("best"), F.countDistinct("at").alias("n_linked"))
    linked = linked.select("__row", F.struct(F.col("best.target.conv_id").alias("c"), F.col("best.target.turn").alias("t")).alias("target"), "n_linked")
    rows = rows.drop("__quoted", "__own").join(linked, "__row", "left")

    # the nearest earlier turn: within runs of turns, and over runs by their largest turn
    run = F.floor(F.coalesce("turn", F.lit(-1)) / _RUN)
    rows = rows.withColumn("__run", run)
    turns = rows.where("turn is not null").groupBy("conv_id", "__run", "turn").agg(F.count(F.lit(1)).alias("n"))
    in_run = Window.partitionBy("conv_id", "__run").orderBy("turn")
    runs = turns.groupBy("conv_id", "__run").agg(F.max("turn").alias("last"))
    runs = runs.select("conv_id", "__run", F.lag("last").over(Window.partitionBy("conv_id").orderBy("__run")).alias("__before"))
    turns = turns.withColumn("__previous", F.lag("turn").over(in_run))
    before = turns.select(F.col("conv_id").alias("c3"), F.col("turn").alias("t3"), "__previous")
    rows = rows.join(before, F.col("conv_id").eqNullSafe(F.col("c3")) & (F.col("turn") == F.col("t3")), "left").drop("c3", "t3")
    runs = runs.select(F.col("conv_id").alias("c4"), F.col("__run").alias("r4"), "__before")
    rows = rows.join(runs, F.col("conv_id").eqNullSafe(F.col("c4")) & (F.col("__run") == F.col("r4")), "left").drop("c4", "r4")
    previous = F.coalesce("__previous", "__before")
    rows = rows.withColumn("parent_turn", F.when(F.col("target").isNotNull(), F.col("target.t")).otherwise(previous))
    rows = rows.withColumn("parent_conv_id", F.when(F.col("target").isNotNull(), F.col("target.c")).when(previous.isNotNull(), F.col("conv_id")))
    rows = rows.withColumn("__parent", F.when(F.col("target").isNotNull() & F.col("target.c").eqNullSafe(F.col("conv_id")), F.col("target.t")).otherwise(previous))

    order = [F.col("__parent").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key"), F.col("role"), F.col("__row")]
    rows = _numbered(rows, "conv_id", order)
    return rows.select("conv_id", "turn", "role", "clean_text", F.col("n_quotes").cast("long").alias("n_quotes"), F.col("max_level").cast("long").alias("max_level"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "parent_conv_id", "parent_turn", "position")


def _numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Add ``position``, counted from 1 in each group. Rows are dealt by ranges of (group, order), so that a large group is spread; the ranges' sizes shift their rows."""
    dealt = rows.repartitionByRange(F.col(group).asc_nulls_first(), *order).withColumn("__range", F.spark_partition_id())
    dealt = materialize(dealt)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("n")).select(F.col(group).alias("__g"), F.col("__range").alias("__r"), before.alias("__shift"))
    place = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order))
    joined = dealt.withColumn("__place", place).join(sizes, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")))
    return joined.withColumn("position", (F.col("__place") + F.col("__shift")).cast("long"))
