"""Operator 6: chat formatting by quotation linking.

Each message is cut into passages: runs of lines with the same number of leading ``>``.
Quoted passages are normalised (lower case, single spaces) and hashed, and the hash is joined
to the messages of the same conversation that said it first, earlier than the quoting one. A
passage is looked up as a whole, as two lines that follow each other and line by line; the
whole goes before pairs, pairs before lines, then the message that holds most of them. The
shallowest passage that links gives the message replied to. Replies form trees; pointer
doubling finds each message's thread and depth, and its place: the number of messages before
it when every message is followed by its replies, each with all that replies to it, before its
next sibling comes. (conv_id, thread, place) is the reply order; ``conversations`` builds one
row for each conversation in it. The text keeps the unquoted passages, without the line that
announces a quote.

Originals are reduced to the first turn per conversation and hash before they are joined, so
a passage said or quoted very often costs one row per key on that side and no pairs arise.

Only built-in functions. Defined results: what has fewer than ``least_chars`` characters is too
common to link, so a quote of only that is counted and not linked; null text counts as empty; null conv_id is one
conversation, a null turn comes before all others and is never replied to; rows that repeat
(conv_id, turn) are kept and share what links to them; an empty table gives no row; other
columns are not read. A very long message is cut into lines once and looked up by hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.shared import shared_folder
from newsflow.operators.ordering import placed

QUOTE = r"^(?:[ \t]*>)+"
#: Fixed forms of a line that announces a quote.
ANNOUNCES = r"(?i)^\s*(?:.* wrote|le .+ a écrit|el .+ escribió|am .+ schrieb.*)\s*:\s*$"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """messages with passages array<struct<level, text>>."""
    m = messages.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    marked = F.transform("_lines", lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), r"[ \t]", "")).alias("level"), F.regexp_replace(x, QUOTE + r"[ \t]?", "").alias("text")))
    m = m.withColumn("_marked", marked)
    starts = F.filter(F.sequence(F.lit(0), F.size("_marked") - 1), lambda i: (i == 0) | (F.get("_marked", i)["level"] != F.get("_marked", F.greatest(i - 1, F.lit(0)))["level"]))
    m = m.withColumn("_starts", starts)

    def passage(start: Column, k: Column) -> Column:
        until = F.coalesce(F.get("_starts", k + 1), F.size("_marked"))
        lines = F.transform(F.slice("_marked", start + 1, until - start), lambda x: x["text"])
        # the announcement stands last before a quote that is deeper
        deeper = F.get("_marked", until)["level"] > F.get("_marked", start)["level"]
        kept = F.when(deeper & F.element_at(lines, -1).rlike(ANNOUNCES), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
        return F.struct(F.get("_marked", start)["level"].alias("level"), F.array_join(kept, "\n").alias("text"))

    return m.withColumn("passages", F.transform("_starts", passage)).drop("_lines", "_marked", "_starts")


def _units(text: Column) -> Column:
    """What a passage is looked up by: struct<kind, text>, kind 0 the whole, 1 two lines, 2 one line."""
    unit = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))
    several = lambda lines: F.concat(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, i: unit(1, F.concat_ws(" ", F.get(lines, i), x))), F.transform(lines, lambda x: unit(2, x)))
    # lines as a bound variable, or each use would split the text again
    lines = F.filter(F.transform(F.split(text, "\n"), normal), lambda x: x != "")
    return F.flatten(F.transform(F.array(lines), lambda lines: F.concat(F.array(unit(0, F.array_join(lines, " "))), F.when(F.size(lines) > 1, several(lines)).otherwise(F.array().cast("array<struct<kind:int,text:string>>")))))


def link(messages: DataFrame, least_chars: int = 8) -> DataFrame:
    """messages(conv_id, turn, role, text) -> conv_id, turn, role, text without quotes, n_quotes, n_linked, reply_to, thread, depth, place."""
    shared_folder(messages.sparkSession)
    m = passages(messages.select("conv_id", "turn", "role", "text")).withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    m = m.withColumn("own", F.filter("passages", lambda p: p["level"] == 0)).withColumn("quoted", F.filter("passages", lambda p: p["level"] > 0))
    m = m.withColumn("own_text", F.array_join(F.filter(F.transform("own", lambda p: p["text"]), lambda x: x.rlike(r"\S")), "\n"))
    m = m.select("conv_id", "_conv", "turn", "role", "own", "own_text", F.size("quoted").alias("n_quotes"), "quoted").checkpoint()
    said = F.concat(F.array(normal(F.col("own_text"))), F.flatten(F.transform("own", lambda p: F.transform(_units(p["text"]), lambda u: u["text"]))))
    said = m.where("turn is not null").select("_conv", "turn", F.explode_outer(F.array_distinct(said)).alias("s")).where(F.length("s") >= least_chars)
    first = said.groupBy("_conv", F.sha2("s", 256).alias("h")).agg(F.min("turn").alias("original"))
    quotes = m.select("_conv", "turn", F.posexplode_outer("quoted").alias("part", "q")).where("q is not null").select("_conv", "turn", "part", "q.level", F.explode_outer(_units(F.col("q.text"))).alias("u"))
    quotes = quotes.where(F.length("u.text") >= least_chars).select("_conv", "turn", "part", "level", "u.kind", F.sha2("u.text", 256).alias("h")).distinct()
    votes = quotes.join(first, ["_conv", "h"]).where("original < turn").groupBy("_conv", "turn", "part", "level", "kind", "original").agg(F.count("*").alias("n"))
    best = votes.groupBy("_conv", "turn", "part", "level").agg(F.min(F.struct("kind", (-F.col("n")).alias("n"), "original")).alias("b"))
    linked = best.groupBy("_conv", "turn").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", (-F.col("b.original")).alias("back"))).alias("b"))
    linked = linked.select("_conv", "turn", "n_linked", (-F.col("b.back")).alias("reply_to")).checkpoint()
    trees = threads(linked.select("_conv", "turn", "reply_to"))
    trees = trees.join(places(linked.select("_conv", "turn", "reply_to")), ["_conv", "turn"])
    out = m.join(linked, ["_conv", "turn"], "left").join(trees, ["_conv", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.col("own_text").alias("text"), "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("place", F.lit(0)).alias("place"),
    )


def threads(replies: DataFrame, most_rounds: int = 60) -> DataFrame:
    """replies(_conv, turn, reply_to) -> _conv, turn, thread, depth by pointer doubling; replies go to earlier turns, so there are no circles."""
    up = replies.select("_conv", "turn", F.col("reply_to").alias("thread"), F.lit(1).alias("depth"))
    for _ in range(most_rounds):
        over = up.select("_conv", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        joined = up.join(over, ["_conv", "thread"], "left")
        if joined.where("next is not null").isEmpty():
            return up
        up = joined.select("_conv", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).checkpoint()
    raise RuntimeError("replies are not a forest")


def places(replies: DataFrame, most_rounds: int = 64) -> DataFrame:
    """replies(_conv, turn, reply_to), one a turn -> _conv, turn, place of each reply among its thread's messages.

    A walk through a thread enters each message, then its replies by turn, and leaves it. The
    steps are a list; by pointer doubling each step learns how many messages are still to be
    entered. Siblings are numbered by a range sort, so no message's replies are one task's work.
    """
    family = replies.withColumn("_family", F.concat_ws(":", "_conv", "reply_to"))
    numbered = placed(family, "_family", "turn")
    after = numbered.select("_family", (F.col("place") - 1).alias("place"), F.col("turn").alias("sibling"))
    nodes = numbered.join(after, ["_family", "place"], "left").select("_conv", "turn", "reply_to", "sibling")
    roots = replies.select("_conv", F.col("reply_to").alias("turn")).join(replies.select("_conv", "turn"), ["_conv", "turn"], "left_anti").distinct()
    nodes = nodes.unionByName(roots.withColumns({"reply_to": F.lit(None).cast("long"), "sibling": F.lit(None).cast("long")}))
    children = replies.groupBy("_conv", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    step = lambda turn, leave: F.struct(turn.cast("long").alias("turn"), F.lit(leave).alias("leave"))
    enter = F.when(F.col("child").isNotNull(), step(F.col("child"), False)).otherwise(step(F.col("turn"), True))
    leave = F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), False)).when(F.col("reply_to").isNotNull(), step(F.col("reply_to"), True))
    both = F.array(F.struct(step(F.col("turn"), False).alias("at"), enter.alias("next"), F.lit(1).alias("left")), F.struct(step(F.col("turn"), True).alias("at"), leave.alias("next"), F.lit(0).alias("left")))
    walk = nodes.join(children, ["_conv", "turn"], "left").select("_conv", F.explode(both).alias("s")).select("_conv", "s.*").checkpoint()
    for _ in range(most_rounds):
        if walk.where("next is not null").isEmpty():
            break
        ahead = walk.select("_conv", F.col("at").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        walk = walk.join(ahead, ["_conv", "next"], "left").select("_conv", "at", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")).checkpoint()
    entered = walk.where("not at.leave").select("_conv", F.col("at.turn").alias("turn"), "left")
    whole = threads(replies).select("_conv", "turn", "thread").join(entered.select("_conv", F.col("turn").alias("thread"), F.col("left").alias("all")), ["_conv", "thread"])
    return whole.join(entered, ["_conv", "turn"]).select("_conv", "turn", (F.col("all") - F.col("left")).alias("place"))


def conversations(linked: DataFrame) -> DataFrame:
    """link's rows -> conv_id, n_messages, messages: one row for each conversation, its messages in reply order as structs of turn, role, text, reply_to and depth. A conversation has to fit into a row; where it doesn't, sort link's rows by (conv_id, thread, place) instead."""
    one = F.struct("thread", "place", F.struct("turn", "role", "text", "reply_to", "depth").alias("m"))
    packed = linked.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return packed.select("conv_id", F.size("all").cast("long").alias("n_messages"), F.transform("all", lambda x: x["m"]).alias("messages"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
