"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text (A-Z lowered) is cut where its own characters say so, so equal passages give equal chunks wherever
they stand. Each distinct chunk is an identifier: hashes and length of its content, verified by grouping
the chunks *by content* once - an identifier that stands for two contents is set apart. A document is
then the ordered list of its chunk identifiers, and only these lists are compared: the text of a document
is moved once, as chunks, however many comparisons follow.

Documents are equal when their lists are; where a list holds an identifier that was set apart, the
SHA-256 of the whole text decides as well.

Defined results: a null text counts as empty (the list without chunks); of equal texts the largest
doc_id stays; rows repeated with one doc_id are all marked as kept; a null doc_id is never larger than
another; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Least and most characters of a chunk, and what must stand before and after a cut: about 1 place in 60.
LEAST, MOST = 1024, 16384
CUT = r"(?<=[aeiou][^a-z0-9])(?=[b-t][a-z])"
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?(?:{CUT}|\z)|.{{1,{MOST}}}"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, all else as it is. ASCII texts take the fast function; others are lowered in their ASCII runs."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]+"), F.lit(0))
    mixed = F.array_join(F.transform(runs, lambda r: F.when(F.ascii(r) < 128, F.lower(r)).otherwise(r)), "")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(mixed)


def chunks(text: Column) -> Column:
    """The chunks of a text in order; none of an empty text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("h"), F.crc32(chunk.cast("binary")).alias("c"), F.octet_length(chunk).alias("n"))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), lower_ascii(F.col(text_col)).alias("t"))
    recipes = texts.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.transform(chunks(F.col("t")), identifier).alias("recipe"))
    recipes = materialize(recipes, "recipes")

    # Verified: grouping by content compares contents, so an identifier with two of them shows.
    contents = texts.select(F.explode(chunks(F.col("t"))).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("uses"))
    apart = contents.select(identifier(F.col("chunk")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    apart = materialize(apart.select("id"), "apart")
    if apart.isEmpty():
        keyed = recipes.withColumn("also", F.lit(""))
    else:
        mixed = recipes.select("text_sha256", F.explode("recipe").alias("id")).join(apart, "id", "left_semi").select("text_sha256").distinct().withColumn("also", F.col("text_sha256"))
        keyed = recipes.join(mixed, "text_sha256", "left").withColumn("also", F.coalesce("also", F.lit("")))

    groups = keyed.groupBy("recipe", "also").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = materialize(groups, "groups")
    out = keyed.join(groups, ["recipe", "also"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


#: The same result in DuckDB's SQL; ids that are unique and not null.
SQL = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM t
"""
