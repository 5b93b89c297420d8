"""Samples by the rank of a hash, length bins, summaries of training sets and of counts, profiles with their alignments.

The rank of a row is the MD5 of a seed and its key, so a sample is the same in every run and SQL can state it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def hash_rank(keys: list[str], seed: int = 0) -> Column:
    """The MD5 of seed:key:key; a null key is left out."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def first_shuffled(df: DataFrame, n: int, order: list[str], keys: list[str], seed: int = 0) -> DataFrame:
    """The first n rows in an order, with rank_key, whose order is a reproducible shuffle of them."""
    return df.orderBy(*order).limit(n).withColumn("rank_key", hash_rank(keys, seed))


def drawn(df: DataFrame, group: list[str], keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group without replacement. Tasks keep their n first rows of a group before any exchange."""
    w = Window.partitionBy(*group).orderBy(hash_rank(keys, seed), *keys)
    return df.withColumn("_draw", F.row_number().over(w)).filter(F.col("_draw") <= n).drop("_draw")


def pool_pairs(pool: DataFrame, group: list[str], key: str, seed: int = 0) -> DataFrame:
    """group, struct, target: each two members of a group's drawn pool once, in a direction that a hash decides."""
    left, right = pool.select(*group, F.col(key).alias("x")), pool.select(*group, F.col(key).alias("y"))
    p = left.join(right, group).filter("x < y")
    turned = F.substring(hash_rank(["x", "y"], seed), 1, 1) < "8"
    return p.select(*group, F.when(turned, F.col("y")).otherwise(F.col("x")).alias("struct"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("target"))


def length_bin(length: Column, low: int, high: int, width: int) -> Column:
    """The bin of a length from low to high, both included; null outside."""
    return F.when(length.between(low, high), F.floor((length - low) / width)).cast("int")


def length_sample(seqs: DataFrame, keys: list[str], low: int, high: int, width: int, most: int, seq: str = "seq", seed: int = 0) -> DataFrame:
    """Columns of seqs and bin: at most `most` sequences of each length bin."""
    binned = seqs.withColumn("bin", length_bin(F.length(seq), low, high, width)).filter("bin is not null")
    return drawn(binned, ["bin"], keys, most, seed)


def length_fill(sample: DataFrame, letters: str, low: int, high: int, width: int, least: int, seed: int = 0) -> DataFrame:
    """bin, tag, seq: for bins with fewer than `least` sequences random ones of the bin's least length.

    Letters are drawn evenly from `letters`; where a letter stands in it more often, it is drawn more often.
    """
    bins = sample.sparkSession.range((high - low) // width + 1).select(F.col("id").cast("int").alias("bin"))
    have = sample.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    tags = bins.join(have, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < least)
    tags = tags.select("bin", F.explode(F.sequence(F.col("n"), F.lit(least - 1).cast("long"))).alias("turn"))
    tags = tags.withColumn("tag", F.concat(F.lit("x"), F.substring(hash_rank(["bin", "turn"], seed), 1, 6)))
    at = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("bin").cast("string"), F.col("turn").cast("string"), k.cast("string"))), 1, 7), 16, 10).cast("long") % len(letters) + 1
    picked = F.transform(F.sequence(F.lit(1), F.col("bin") * width + low), lambda k: F.substring(F.lit(letters), at(k).cast("int"), F.lit(1)))
    return tags.select("bin", "tag", F.array_join(picked, "").alias("seq"))


def training_neff(pairs: DataFrame, x_neff: str | None = "x_neff", y: str = "y") -> DataFrame:
    """neff_x, neff_y: means of the central effective number of the windows and of the column sums of a training set.

    x_neff is an array a window (1 for sequences, where it is None), y an array of the column's values.
    """
    mid = F.lit(1.0) if x_neff is None else F.element_at(F.col(x_neff), (F.floor((F.size(x_neff) - 1) / 2) + 1).cast("int")).cast("double")
    total = F.aggregate(F.transform(F.col(y), lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return pairs.agg(F.avg(mid).alias("neff_x"), F.avg(total).alias("neff_y"))


def count_statistics(counts: DataFrame, cells: int, value: str = "n") -> DataFrame:
    """total, least, most, mean of a table of counts with `cells` cells; cells without a row count as 0."""
    s = counts.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("rows"))
    least = F.when(F.col("rows") < cells, F.least(F.lit(0.0), "low")).otherwise(F.col("low"))
    return s.select("total", least.alias("least"), F.greatest(F.lit(0.0), "high").alias("most"), (F.col("total") / F.lit(float(cells))).alias("mean"))


def with_alignments(profiles: DataFrame, alignments: DataFrame) -> DataFrame:
    """name, columns, matches, fits of profiles (path, columns) and alignments (path, matches) by the names of their files.

    matches is null for a profile without an alignment; fits says that both have as many columns.
    """
    p = profiles.select(scalars.stem(F.col("path")).alias("name"), "columns")
    a = alignments.select(scalars.stem(F.col("path")).alias("name"), "matches")
    return p.join(a, "name", "left").select("name", "columns", "matches", F.coalesce(F.col("columns") == F.col("matches"), F.lit(False)).alias("fits"))


def checked_alignments(profiles: DataFrame, alignments: DataFrame) -> DataFrame:
    """with_alignments, failing on the first profile whose alignment is missing or has another number of match columns."""
    said = F.concat(F.lit("match columns of "), "name", F.lit(": "), F.coalesce(F.col("matches").cast("string"), F.lit("no alignment")), F.lit(" instead of "), F.col("columns").cast("string"))
    return with_alignments(profiles, alignments).withColumn("fits", F.when(F.col("fits"), True).otherwise(F.raise_error(said).cast("boolean")))
