"""Exact deduplication by full content, with DataFrame functions only.

Rows are combined three times, and each time rows meet only when their whole normalised texts are equal; the SHA-256
digest merely deals them out and lets comparisons end early:

1. locally: the map side of the first aggregation combines equal texts of one input partition and salt;
2. salted digest groups: its reduce side, keyed by digest, salt and text, so that a group of copies that holds a third
   of all rows is met by as many tasks as there are salts;
3. globally: the winners of the salts, at most one for each salt, meet by digest and text, and their number with them.

What the winners agree on goes back to the salted groups, in which the document ids have stayed: no task holds more ids
of a group of copies than one salt has. The salts grow with the number of shuffle partitions. A text crosses the network
once for each salt that it occurs in, twice in all for a text without copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _salted(rows: DataFrame, digest=None, salts: int | None = None) -> DataFrame:
    """doc_id, the normalised text, its digest and a salt of every row (doc_id, text)."""
    salts = salts or max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("doc_id", normalise(F.col("text")).alias("text"))
    # Never null, so that a join on them adds no filter and what reads the groups twice shuffles the texts once.
    rows = rows.withColumn("digest", F.coalesce((digest or (lambda c: F.sha2(c, 256)))(F.col("text")), F.lit("")))
    return rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(salts)), F.lit(0)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None, salts: int | None = None) -> DataFrame:
    """One row per row of docs: its id, keep_id (largest id among equal texts), group_size, kept and text_sha256.

    Null texts count as empty, and empty texts are equal to each other. Rows that repeat an id are all returned, and
    one of them is kept. A null id ranks below all others. Extra columns are ignored whatever their names. An empty
    table gives an empty result. `digest` replaces SHA-256 in tests, to show that unequal texts never meet.
    """
    salted = _salted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), digest, salts)
    # Nulls would vanish from collect_list, so ids ride in a struct. Both sides below read one shuffle of the texts.
    groups = salted.groupBy("digest", "salt", "text").agg(F.collect_list(F.struct("doc_id")).alias("ids"), F.max("doc_id").alias("best"))
    # A salted group is told from others by its digest, salt and best id, and where even those are equal by its text's hash.
    name = [F.col("digest"), F.col("salt"), F.col("best").isNull().alias("no_best"), F.coalesce(F.col("best").cast("string"), F.lit("")).alias("best_id"), F.xxhash64("text").alias("mark")]
    keys = ["digest", "salt", "no_best", "best_id", "mark"]
    whole = Window.partitionBy("digest", "text")
    # The ids come first, as in the groups: both sides then have the same aggregation, and its shuffle is made once.
    winners = groups.select(F.size("ids").alias("n"), "best", "digest", "salt", "text").select(
        *name, F.max("best").over(whole).alias("keep_id"), F.sum("n").over(whole).alias("group_size"))
    won = groups.select(*name, "ids").join(winners, keys)
    # Of rows that repeat the kept id the first in their list stays; equal ids share a salt, hence a list.
    place = F.array_position(F.col("ids"), F.struct(F.col("keep_id").alias("doc_id")))
    out = won.select("keep_id", "group_size", "digest", place.alias("place"), F.posexplode("ids").alias("at", "row"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("at") + 1 == F.col("place")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, one for each distinct normalised text, with all their columns."""
    key = lambda c: F.struct(F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("key")
    groups = _salted(docs.select("doc_id", "text")).groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("best"))
    stay = groups.groupBy("digest", "text").agg(F.max("best").alias("best")).select(key("best"), "digest")
    # All columns in one, so that none can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key("doc_id"), F.sha2(normalise(F.col("text")), 256).alias("digest"))
    # Rows that repeat an id and its text: one of them.
    first = F.row_number().over(Window.partitionBy("key", "digest").orderBy("key"))
    return rows.join(stay, ["key", "digest"], "left_semi").withColumn("first", first).where("first = 1").select("row.*")
