"""Chat formatting by quotation linking.

Messages are parsed into lines of nested quote levels. Quoted passages are
normalised, hashed and joined to the first message of the conversation that
says them itself; a message answers the one that its outermost quotes come
from. Conversations are then ordered by reply, without the quotes. Everything
on the rows is built-in SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, freed_shuffles, read_table, text_or_empty, written

#: Quote markers at the start of a line: each ``>`` is one level.
MARKERS = r"^(?:[ \t]*>)+"
#: A line that tells whom the quote below it is from.
ATTRIBUTION = r"(?i)\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"


@dataclass(frozen=True)
class Linking:
    """``least_chars``: shorter lines aren't sought by themselves, as they are too common.

    ``span``: consecutive root turns of a conversation, and turns of a thread, that one task orders.
    """

    least_chars: int = 12
    span: int = 256


def normal_passage(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _parsed(text: Column) -> Column:
    """array<struct<level, body>> of a text's lines."""
    return F.transform(
        F.split(text, "\r?\n"),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKERS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKERS + " ?", "").alias("body")),
    )


def _own(lines: str) -> Column:
    """The text without quoted lines, and without the lines that announce them."""
    announces = lambda x, i: x["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~announces(x, i))
    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _hashes(texts: Column) -> Column:
    """array<struct<hash, chars>> of the normalised texts that aren't empty."""
    normal = F.filter(F.transform(texts, normal_passage), lambda x: x != "")
    return F.array_distinct(F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("hash"), F.length(x).alias("chars"))))


def _passages(messages: DataFrame, linking: Linking) -> DataFrame:
    """(message, conv, at, passage, level, hash, chars): the hashes by which each quoted passage is sought.

    A passage is a run of lines of one level; a line without text ends it.
    It is sought as a whole and by its longer lines.
    """
    lines = messages.where(F.exists("lines", lambda x: x["level"] > 0)).select("message", "conv", "at", F.posexplode("lines").alias("i", "x"))
    lines = lines.select("message", "conv", "at", "i", F.when(F.trim("x.body") == "", 0).otherwise(F.col("x.level")).alias("level"), "x.body")
    order = Window.partitionBy("message").orderBy("i")
    runs = lines.withColumn("new", F.coalesce((F.lag("level").over(order) != F.col("level")).cast("int"), F.lit(1))).withColumn("passage", F.sum("new").over(order))
    runs = runs.where("level > 0").groupBy("message", "conv", "at", "passage", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]).alias("bodies"))
    whole = _hashes(F.array(F.array_join("bodies", " ")))
    single = F.filter(_hashes(F.col("bodies")), lambda x: x["chars"] >= linking.least_chars)
    return runs.select("message", "conv", "at", "passage", "level", F.explode(F.array_distinct(F.concat(whole, single))).alias("h")).select("message", "conv", "at", "passage", "level", "h.*")


def _originals(messages: DataFrame, linking: Linking) -> DataFrame:
    """(conv, hash, first): the first turn that says a text itself; one row each, however often it is said."""
    paragraphs = F.split("own", r"\n\s*\n")
    single = F.filter(_hashes(F.split("own", "\n")), lambda x: x["chars"] >= linking.least_chars)
    every = F.array_distinct(F.concat(_hashes(F.array("own")), _hashes(paragraphs), single))
    said = messages.where("own <> '' and at is not null").select("conv", "at", F.explode(every).alias("h"))
    return said.groupBy("conv", F.col("h.hash").alias("hash")).agg(F.min("at").alias("first"))


def _roots(replies: DataFrame) -> DataFrame:
    """(conv, at, root) of messages that answer another: pointers are doubled until all end at roots."""
    now = written(replies.select("conv", "at", F.col("reply_to").alias("root")), "roots")
    while True:
        over = now.select("conv", F.col("at").alias("root"), F.col("root").alias("beyond"))
        after = written(now.join(over, ["conv", "root"], "left").select("conv", "at", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        drop_written(now)
        now = after
        if not moved:
            return now.select("conv", "at", "root")


def link_quotations(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text: str = "text", linking: Linking = Linking()) -> DataFrame:
    """One row per message: conversation, turn, role, text without quotes, and how it hangs together.

    ``quotes`` lists (level, digest, from_turn) of the quoted passages in
    order; ``reply_to`` is the turn that the outermost of them come from
    (most characters, then the later turn); ``thread`` the first turn of its
    line of replies; ``position`` its place in the conversation, from 0:
    threads by their first turn, a thread's messages by turn. ``copies``
    counts repeated rows, which are one message.

    A passage comes from the first earlier turn that says it itself as a
    whole text, paragraph or line; very long texts are read whole. Null texts count as empty. Messages
    without a turn come last and are linked to nothing; a null conversation
    is one of its own. An empty table gives no rows; other columns are left out.
    """
    spark = chats.sparkSession
    rows = chats.select(F.col(conv_col).alias("conv_value"), F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("conv"), F.col(turn_col).alias("at"), F.col(role_col).alias("role"), text_or_empty(text).alias("text"))
    rows = rows.groupBy("conv_value", "conv", "at", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("message", F.xxhash64("conv", "at", F.coalesce(F.length("role"), F.lit(-1)), "role", "text")).withColumn("lines", _parsed(F.col("text")))
    with freed_shuffles(spark):
        messages = written(rows.withColumn("own", _own("lines")).drop("text"), "messages")
        passages = _passages(messages, linking)
        found = passages.join(_originals(messages, linking), ["conv", "hash"], "left").withColumn("first", F.when(F.col("first") < F.col("at"), F.col("first")))
        per = found.groupBy("message", "passage", "level", "first").agg(F.sum("chars").alias("chars"), F.max_by("hash", "chars").alias("digest"))
        best = per.groupBy("message", "passage", "level").agg(F.max(F.struct(F.col("first").isNotNull().alias("linked"), "chars", "first")).alias("b"), F.max_by("digest", "chars").alias("digest"))
        quotes = best.groupBy("message").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("passage", "level", "digest", F.col("b.first").alias("from_turn"), F.col("b.chars").alias("chars")))), lambda q: q.dropFields("passage")).alias("quotes")
        )
        quotes = written(quotes, "quotes")
        answered = messages.select("message", "conv", "at").join(quotes, "message").where("at is not null")
        linked = answered.select("conv", "at", F.explode(F.filter("quotes", lambda q: q["from_turn"].isNotNull())).alias("q"))
        outer = linked.groupBy("conv", "at").agg(F.min("q.level").alias("outer"))
        # Messages that share a turn answer together.
        votes = linked.join(outer, ["conv", "at"]).where("q.level = outer").groupBy("conv", "at", F.col("q.from_turn").alias("from_turn")).agg(F.sum("q.chars").alias("chars"))
        replies = written(votes.groupBy("conv", "at").agg(F.max(F.struct("chars", "from_turn")).alias("b")).select("conv", "at", F.col("b.from_turn").alias("reply_to")), "replies")
        roots = _roots(replies)
        hung = messages.join(quotes, "message", "left").join(replies, ["conv", "at"], "left").join(roots, ["conv", "at"], "left").withColumn("thread", F.coalesce("root", "at"))
        hung = written(hung.drop("root"), "hung")
        for df in (messages, quotes, replies):
            drop_written(df)
    # Places in three steps, so that neither a conversation nor a thread is sorted as a whole: both may be a third of all rows.
    last = F.lit(1 << 62)
    within = F.when(F.col("at").isNull(), F.shiftright("message", 56)).otherwise(F.floor(F.col("at") / linking.span))
    hung = hung.withColumns({"stretch": F.coalesce(F.floor(F.col("thread") / linking.span), last), "of_thread": F.coalesce("thread", last), "within": within})
    blocks = hung.groupBy("conv", "stretch", "of_thread", "within").agg(F.count(F.lit(1)).alias("n"))
    stretches = blocks.groupBy("conv", "stretch").agg(F.sum("n").alias("n"))
    above = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stretches.select("conv", "stretch", above(Window.partitionBy("conv").orderBy("stretch")).alias("start"))
    offsets = blocks.select("conv", "stretch", "of_thread", "within", above(Window.partitionBy("conv", "stretch").orderBy("of_thread", "within")).alias("offset"))
    inside = Window.partitionBy("conv", "stretch", "of_thread", "within").orderBy(F.col("at").asc_nulls_last(), F.when(F.col("at").isNotNull(), F.col("role")), "message")
    placed = hung.withColumn("nth", F.row_number().over(inside) - 1).join(offsets, ["conv", "stretch", "of_thread", "within"]).join(starts, ["conv", "stretch"])
    slim = F.transform(F.coalesce("quotes", F.array().cast(hung.schema["quotes"].dataType)), lambda q: F.struct(q["level"].alias("level"), q["digest"].alias("digest"), q["from_turn"].alias("from_turn")))
    return placed.select(
        F.col("conv_value").alias(conv_col),
        F.col("at").alias(turn_col),
        F.col("role").alias(role_col),
        F.col("own").alias(text),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("n_quoted_lines"),
        F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).alias("max_level"),
        slim.alias("quotes"),
        "reply_to",
        "thread",
        (F.col("start") + F.col("offset") + F.col("nth")).cast("long").alias("position"),
        "copies",
    )


def op4_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of ``conversations``, linked; nulls, repeats and empty tables as in :func:`link_quotations`."""
    return link_quotations(read_table(spark, sf_dir, "conversations"))
