"""Exact dedup by skew-safe combining, in DataFrame functions only.

1. Locally: rows of one text inside an input partition are combined by the map side of a grouped aggregate.
2. Salted groups: (digest, content, salt) is merged next. The salt is the id's block of BLOCK consecutive ids, so a
   group lists at most BLOCK distinct ids, however many copies a text has. Null ids of a text are one group, and rows
   that repeat an id are in one group, whatever their number.
3. Globally: the salts' winners and counts of one (digest, content) are combined, on the map side first, with the set of
   the shards that the salts' hashes fall into, of which there are SHARDS. No list of salts is ever made, so the ids of
   a hot text may be as sparse as they like.

The full content is part of every grouping key, so two texts that shared a digest would stay apart there. The join of
the salts' members with what was decided has the digest, the shard and the content's length and hash as its key, not
the content; a hot text is SHARDS keys there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of space, tab, line feed, vertical tab, form feed and carriage return count as one space.
WHITE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
BLOCK = 4096
SHARDS = 256


def normalized(text: Column) -> Column:
    """The text with each white-space run replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the smallest id is kept. Null and empty texts are equal to each other. A
    null id sorts after every other id; where rows repeat an id, exactly one of them is kept. Other columns of docs,
    whatever their names, are not looked at. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalized(F.col(text_col)).alias("content"))
    rows = rows.select(
        F.sha2("content", 256).alias("digest"),
        "content",
        F.coalesce(F.floor(F.col("doc_id") / block), F.lit(-1)).alias("salt"),
        F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id")).alias("member"),
    )
    salted = rows.groupBy("digest", "content", "salt").agg(F.collect_list("member").alias("members"))
    # never null, or else the join asks for it on one side only and the salted groups are made twice
    shard = F.coalesce(F.pmod(F.xxhash64("salt"), F.lit(shards)), F.lit(0))
    salted = salted.withColumns({"winner": F.array_min("members"), "shard": shard, "length": F.octet_length("content"), "hash": F.xxhash64("content")})
    whole = salted.groupBy("digest", "content", "length", "hash").agg(
        F.min("winner").alias("keep"), F.sum(F.size("members").cast("long")).alias("group_size"), F.collect_set("shard").alias("in_shards")
    )
    parts = whole.select("digest", "length", "hash", "keep", "group_size", F.explode("in_shards").alias("shard"))
    members = salted.select("digest", "shard", "length", "hash", "winner", "members")
    joined = members.join(parts, ["digest", "shard", "length", "hash"])
    listed = joined.select(
        F.col("digest").alias("text_sha256"),
        "keep",
        "group_size",
        F.col("winner").eqNullSafe(F.col("keep")).alias("holds_winner"),
        F.posexplode(F.array_sort("members")).alias("nth", "member"),
    )
    return listed.select(
        F.col("member.id").alias("doc_id"),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("holds_winner") & (F.col("nth") == 0)).alias("kept"),
        "text_sha256",
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with one row of each text, all columns as they were."""
    def key(sha: Column, row_id: Column) -> Column:
        return F.concat_ws("|", sha, F.coalesce(row_id.cast("string"), F.lit("none")))

    kept = exact_dedup(docs, id_col, text_col, block).filter("kept").select(key(F.col("text_sha256"), F.col("doc_id")).alias("_key"))
    keyed = docs.withColumn("_key", key(F.sha2(normalized(F.col(text_col)), 256), F.col(id_col).cast("long")))
    # one key without nulls, so that the join's partitioning also serves the rows that repeat
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


#: Oracle of op1_exact_dedup.
OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
), g AS (
  SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY content
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.content) AS text_sha256
FROM n JOIN g USING (content)
"""
