"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text without white space is cut into chunks whose ends depend on the content alone, so equal
texts have equal chunks and an insertion moves few boundaries. A chunk's identifier is its 64-bit
hash; one aggregation over all chunks verifies that a hash stands for one text only, moving each
distinct chunk once (partial aggregation drops repeats before the shuffle). A document is then the
ordered list of its identifiers, 8 bytes for a few hundred characters, and only these lists are
compared: long documents are never moved whole. Where a hash is shared by two different chunks, the
documents that hold it are compared by their texts instead, so the result is exact for all inputs.

Nulls, empty texts: both are the empty text, an empty recipe, and equal to each other.
Repeated rows: rows with equal ids are separate rows of the same group; one row of a group stays.
A null id is smaller than any other. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, col, table, written

#: A chunk has 96 to 768 characters and ends, where it can, behind a vowel and one of a few consonants.
MIN_CHARS, MAX_CHARS, BOUNDARY = 96, 768, "[aeiou0-4][dfgkmpvwxz5-9]"


def chunk_texts(norm, least: int = MIN_CHARS, most: int = MAX_CHARS, boundary: str = BOUNDARY):
    """The ordered chunks of a normalised text as an array of strings; the empty text has none."""
    whole = rf"(?s).{{{least},{most - 2}}}?{boundary}|.{{1,{most}}}"
    return F.regexp_extract_all(norm, F.lit(whole), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **chunking) -> DataFrame:
    """(doc_id, n_points, norm, recipe): the recipe is the ordered list of chunk hashes."""
    raw = F.coalesce(col(text_col), F.lit(""))
    out = docs.select(col(id_col).alias("doc_id"), F.char_length(raw).cast("long").alias("n_points"), F.regexp_replace(raw, WHITE, "").alias("norm"))
    return out.withColumn("recipe", F.transform(chunk_texts(F.col("norm"), **chunking), lambda c: F.xxhash64(c)))


def chunk_collisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=F.xxhash64, **chunking) -> DataFrame:
    """Hashes that stand for more than one chunk text: the identifiers that verification rejects."""
    raw = F.coalesce(col(text_col), F.lit(""))
    chunk = docs.select(F.explode(chunk_texts(F.regexp_replace(raw, WHITE, ""), **chunking)).alias("chunk"))
    return chunk.distinct().select(hashed("chunk").alias("h")).groupBy("h").count().filter("count > 1").select("h")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **chunking) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (white space deleted) the row with the most code points stays, then the smallest id.
    """
    bad = chunk_collisions(docs, id_col, text_col, **chunking)
    r = recipes(docs, id_col, text_col, **chunking).withColumn("apart", F.lit(""))
    if not bad.isEmpty():  # the verification: nearly always empty, and then recipes alone decide
        doubtful = r.select("doc_id", F.explode("recipe").alias("h")).join(bad, "h", "left_semi").select(F.col("doc_id").alias("bad_id")).distinct()
        r = r.join(doubtful, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left").withColumn("apart", F.when(F.col("bad_id").isNotNull(), F.col("norm")).otherwise(""))
    # Recipes are written, so texts are cut once, and rows have a number that tells repeated ones apart.
    keyed = r.select("doc_id", "n_points", "recipe", "apart", F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    keyed = written(keyed, "recipes")
    best = F.min(F.struct((-F.col("n_points")).alias("p"), "doc_id", "row"))
    groups = keyed.groupBy("recipe", "apart").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("recipe", "apart", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    return keyed.join(groups, ["recipe", "apart"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n_points DESC, doc_id NULLS FIRST)
"""
