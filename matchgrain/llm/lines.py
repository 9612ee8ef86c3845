"""Recurring lines by a log-template tree: token count and leading tokens, then variable fields.

A line goes down a tree of fixed depth: its number of tokens, then its first `depth` tokens, where a token
with a digit reads `<*>`. The distinct lines of a leaf vote on each further position: a token that at
least half of them hold there is a constant, any other position is a variable field. A line that agrees with
the constants of its leaf in at least `similarity` of its tokens is an instance of the template of the leaf; any
other line is a template of its own (with `<*>` for tokens with a digit). A template that occurs in at least
`min_documents` different texts recurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.llm.tables import stored
from matchgrain.llm.textcore import column_words

DEPTH, SIMILARITY, MIN_DOCUMENTS = 4, 0.7, 5


def masked_tokens(line: Column) -> Column:
    """Tokens of a line; `<*>` for each that holds a digit."""
    tokens = column_words(line)
    return F.when(line.rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))).otherwise(tokens)


def recurring_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(text_key, drop): for each distinct text with recurring lines, the sorted numbers (from 0) of those it loses.

    text_key is the 64-bit hash of the text. A template keeps its lines in one text, that of the smallest doc_id
    holding it (a null doc_id comes last, then the smallest key), and loses them in all others. Texts that are equal
    count once and share their fate, so copies of a document are left to document dedup.
    """
    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = texts.where("text is not null").select("text_key", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("text_key", "doc_id", "line_no", masked_tokens(F.col("line")).alias("tokens")).where(F.size("tokens") > 0)
    # A line travels as one string; it is cut into tokens again where it is used.
    lines = lines.select("text_key", "doc_id", "line_no", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf"), F.array_join("tokens", " ").alias("content"))
    busy = lines.select("leaf", "text_key").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("leaf")
    # Equal texts give one row: smallest doc_id.
    owned = lines.join(busy, "leaf").groupBy("leaf", "text_key", "line_no").agg(F.min("doc_id").alias("doc_id"), F.first("content").alias("content"))
    owned = stored(owned.withColumn("content_key", F.xxhash64("content")), "lines")

    contents = owned.groupBy("leaf", "content_key").agg(F.first("content").alias("content")).withColumn("tokens", F.split("content", " "))
    votes = contents.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count("*").alias("votes"))
    firm = votes.groupBy("leaf", "at").agg(F.max(F.struct("votes", "token")).alias("top"), F.sum("votes").alias("all"))
    constants = (
        firm.withColumn("token", F.when(2 * F.col("top.votes") >= F.col("all"), F.col("top.token")))
        .groupBy("leaf")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("constants"))
    )
    agreed = F.size(F.filter(F.zip_with(F.split("content", " "), "constants", lambda a, b: a == b), lambda same: same))
    named = contents.select("leaf", "content_key", "content").join(constants, "leaf").select(
        "leaf", "content_key", F.when(agreed >= similarity * F.size("constants"), F.lit(0)).otherwise(F.col("content_key")).alias("template")
    )
    placed = owned.select("leaf", "content_key", "text_key", "line_no", "doc_id").join(named, ["leaf", "content_key"])
    rank = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id"), F.col("text_key"))
    support = placed.groupBy("leaf", "template", "text_key").agg(F.min("doc_id").alias("doc_id")).groupBy("leaf", "template").agg(
        F.count("*").alias("texts"), F.min(rank)["text_key"].alias("owner")
    )
    lost = placed.join(support.where(F.col("texts") >= min_documents), ["leaf", "template"]).where("text_key <> owner")
    return lost.groupBy("text_key").agg(F.array_sort(F.collect_set("line_no")).alias("drop"))


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """`docs` with shorter `text`, plus n_lines, n_dropped (long): recurring lines go from all texts but the first that holds them.

    Every row comes out once, null, empty and repeated ones unchanged; blank lines are never dropped. A null text
    has 0 lines. The rest of the lines is joined by \\n as before. Other columns are kept.
    """
    drops = recurring_lines(docs, depth, similarity, min_documents).select(F.col("text_key").alias("_key"), F.col("drop").alias("_drop"))
    keyed = docs.withColumn("_key", F.when(F.col("text").isNotNull(), F.xxhash64(F.col("text").cast("string"))))
    joined = keyed.join(drops, "_key", "left").withColumn("_lines", F.split(F.col("text").cast("string"), "\n"))
    left = F.array_join(F.filter("_lines", lambda x, i: ~F.array_contains("_drop", i)), "\n")
    return (
        joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("_drop"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(left))
        .drop("_key", "_drop", "_lines")
    )
