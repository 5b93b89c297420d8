"""The corpus pipeline: documents in, sampled piece segmentations of the mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import language_id, line_dedup, ngram_join, piece_sampling, source_mix
from strandline.llm.common import col, fresh, table, written

#: A document is rejected whose language is unknown or whose best language is less likely than this: the network's class of
#: no language takes what is in none. Of 6,700 held-out rows of labelled prose the least had 0.45; ten texts in other languages had 0.09 at most.
LEAST_SCORE = 0.3
#: A line on more than this share of a source's different texts, and on so many at least, is boilerplate.
LINE_RATIO, LINE_LEAST = 0.1, 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known; learns from the rows that are not held out."""
    net = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    known = language_id.predict(docs, net, keep=True)
    lang, score = known.columns[-2:]
    return known.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*map(col, docs.columns))


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines of each source; equal texts of a source count once."""
    return line_dedup.dedup_documents(docs, ratio=LINE_RATIO, least_pages=LINE_LEAST, distinct_pages=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates (five words, 0.8)."""
    return ngram_join.keep_one(docs, words=ngram_join.NAMED_WORDS, percent=ngram_join.NAMED_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by the number of copies that the mix takes of each; copies are a row's own, nothing is joined back by id."""
    mixed = source_mix.pareto_mix(docs, keep=True)
    copies, turn = mixed.columns[-1], fresh(mixed.columns, "turn")[0]
    return mixed.filter(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*map(col, docs.columns))


def sample_segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every row."""
    return piece_sampling.sample_pieces(docs, piece_sampling.model_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_site_lines),
    ("ngram_join", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("piece_sampling", sample_segmentations),
]

#: The stages learn, sample and walk lattices, which SQL does not state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
