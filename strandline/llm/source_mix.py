"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a target in words. A document of the source is wanted c * k times, at most `most`
times, where k is its size class (the binary digits of its number of words) and c is solved for each
source so that the words wanted are the target: longer documents have the larger inclusion odds. The
whole part of what is wanted is taken for certain, as copies; the rest f is an inclusion probability.
Documents of a source are ranked by random odds over inclusion odds, (u / (1 - u)) / (f / (1 - f)),
u being a hash of id, text and seed; the ranking is cut where the words taken come nearest to what
the certain copies leave open, so the sample has a fixed size in words.

Nothing orders a source: sums for each (source, class) solve c, and the cut is narrowed down by the
sums of 64 intervals of the rank a source, four times, each within the interval before; only the ranks in
the last interval are looked at one by one. A row then decides by its own rank and its source's cut,
so copies are never joined back to rows. A source may hold any share of the rows.

Null texts have size 0; a null source is a source of its own, last. Repeated rows share their rank and
are taken alike; so are, at the cut, rows of equal rank. A table without words has targets of 0.
Extra columns are not read; with `keep` they come through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, col, fresh, n_words, table
from .line_dedup import host_key

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 7
#: Intervals of a narrowing of the cut, and how often it is narrowed.
PARTS, ROUNDS = 64, 4


def unit_hash(key, text, seed: int):
    """A number strictly between 0 and 1 from the md5 of key, seed and text (48 bits, also plain SQL)."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(seed)), F.coalesce(text, F.lit("")))), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def size_class(size):
    """The number of binary digits of a size: 1 for 0 and 1, one more each time it doubles."""
    return F.length(F.bin(size)).cast("double")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with target: share of all sizes by weight, none above most times its source.

    Resharing an excess by weight until none is above its cap equals filling sources in ascending
    order of cap / weight: the first ones are capped, the others share what is left by weight.
    One row for each source.
    """
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    t = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    up = every.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({"all": F.lit(float(share)) * F.sum("source_size").over(every), "w_all": F.sum("w").over(every), "cap_to": F.sum("cap").over(up), "w_to": F.sum("w").over(up)})
    left, w_left = F.col("all") - (F.col("cap_to") - F.col("cap")), F.col("w_all") - (F.col("w_to") - F.col("w"))
    t = t.withColumn("capped", F.col("cap") * w_left <= F.col("w") * left)
    t = t.withColumns({"cap_sum": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every), "w_sum": F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0.0)).over(every)})
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * ((F.col("all") - F.col("cap_sum")) / (F.col("w_all") - F.col("w_sum")))).alias("target"))


#: A table with one row for each source and class is broadcast up to this many rows; beyond, the join is left to adaptive execution.
FEW_ROWS = 100_000


def _small(per_source: DataFrame) -> DataFrame:
    return F.broadcast(per_source) if per_source.count() <= FEW_ROWS else per_source


def class_shares(sums: DataFrame, most: float = MOST) -> DataFrame:
    """From (key, k, n, target), n being the words of a class: (key, k) with whole copies, the rest f and the words open.

    min(most, c * k) times the words of each class are to sum to the target. The largest classes reach
    `most` first; c follows from what they leave. One row for each source and class, some 20 a source.
    """
    every, up = Window.partitionBy("key"), Window.partitionBy("key").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = sums.withColumn("kn", F.col("k") * F.col("n"))
    t = t.withColumns({"kn_all": F.sum("kn").over(every), "kn_to": F.sum("kn").over(up), "n_to": F.sum("n").over(up)})
    left, kn_left = F.col("target") - F.lit(float(most)) * (F.col("n_to") - F.col("n")), F.col("kn_all") - (F.col("kn_to") - F.col("kn"))
    t = t.withColumn("full", F.lit(float(most)) * kn_left <= F.col("k") * left)
    t = t.withColumns({"n_full": F.sum(F.when(F.col("full"), F.col("n")).otherwise(0)).over(every), "kn_free": F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("kn"))).over(every)})
    want = F.when(F.col("full"), F.lit(float(most))).when(F.col("kn_free") > 0, F.least(F.lit(float(most)), F.col("k") * ((F.col("target") - F.lit(float(most)) * F.col("n_full")) / F.col("kn_free")))).otherwise(0.0)
    t = t.withColumn("want", F.greatest(want, F.lit(0.0))).withColumn("whole", F.floor("want").cast("long")).withColumn("f", F.col("want") - F.col("whole"))
    return t.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("n")).over(every)).select("key", "k", "whole", "f", "rest")


def _rank():
    """Random odds over inclusion odds as a number from 0 to 1; null where nothing is left to chance."""
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f")))
    return F.when(F.col("f") > 0, q / (1 + q))


def _cuts(ranked: DataFrame) -> DataFrame:
    """From (key, v, size, rest): (key, cut), the largest rank that is taken; half of the rows of a rank must fit."""
    cut = None
    before = Window.partitionBy("key").orderBy("v")
    for turn in range(1, ROUNDS + 1):
        parts = float(PARTS**turn)
        at = F.least(F.floor(F.col("v") * parts), F.lit(parts - 1)).cast("long")
        some = ranked.withColumn("at", at)
        if cut is None:
            some = some.withColumn("under", F.lit(0).cast("long"))
        else:
            some = some.join(cut, "key").filter(F.floor(F.col("at") / PARTS) == F.col("inside"))
        sums = some.groupBy("key", "at").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("under").alias("under"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("at")) + F.col("under"))
        # The first interval that goes beyond what is open; if none does, the last one.
        first = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("at", (F.col("upto") - F.col("n")).alias("under"))))
        last = F.max(F.struct("at", (F.col("upto") - F.col("n")).alias("under")))
        cut = sums.groupBy("key").agg(F.coalesce(first, last).alias("x")).select("key", F.col("x.at").alias("inside"), "x.under")
        cut = _small(checkpointed(cut))
    each = ranked.withColumn("at", at).join(cut, "key").filter(F.col("at") == F.col("inside")).groupBy("key", "v").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("under").alias("under"), F.first("inside").alias("inside"))
    fits = F.col("under") + F.sum("n").over(before) - F.col("n") / 2 <= F.col("rest")
    best = each.withColumn("fits", fits).groupBy("key").agg(F.max(F.when(F.col("fits"), F.col("v"))).alias("v"), F.min(F.col("v")).alias("least"))
    # Where none of the last interval fits, all ranks below it do.
    return best.select("key", F.col("v").alias("cut"), "least")


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, keep: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, want: copies is what the mix takes of a row, want its expectation.

    With keep: the columns of docs, and the number of copies in a last column whose name no other has.
    """
    own = docs
    if not keep:
        own = docs.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), col(text_col).alias("text"))
        id_col, source_col, text_col = "doc_id", "source", "text"
    names = dict(zip(("key", "k", "size", "u"), fresh(own.columns, "key", "k", "size", "u"), strict=True))
    own = own.withColumns({names["key"]: host_key(col(source_col)), names["size"]: n_words(col(text_col)), names["u"]: unit_hash(col(id_col), col(text_col), seed)})
    own = own.withColumn(names["k"], size_class(F.col(names["size"])))
    if not keep:
        own = checkpointed(own.drop("text"))  # a few bytes a row: the texts are read once
    base = own.select(*[F.col(v).alias(x) for x, v in names.items()], col(source_col).alias("source"))
    base = checkpointed(base) if keep else base
    per = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).select(host_key(F.col("source")).alias("key"), "source_size", "target")
    per = checkpointed(per)
    sums = base.groupBy("key", "k").agg(F.sum("size").alias("n"))
    shares = _small(checkpointed(class_shares(sums.join(_small(per), "key"), most).join(per, "key")))
    ranked = base.join(shares, ["key", "k"]).withColumn("v", _rank()).filter("v is not null").select("key", "v", "size", "rest")
    table_ = checkpointed(shares.join(_cuts(ranked), "key", "left"))
    added = fresh([*own.columns, *docs.columns], "want", "whole", "f", "cut", "least", "source_size", "target", "copies")
    want, whole, f, cut, least, source_size, target, copies = added
    other_key, other_k = fresh([*own.columns, *added], "key", "k")
    final = table_.select(F.col("key").alias(other_key), F.col("k").alias(other_k), (F.col("whole") + F.col("f")).alias(want), F.col("whole").alias(whole), F.col("f").alias(f), F.col("cut").alias(cut), F.col("least").alias(least), F.col("source_size").alias(source_size), F.col("target").alias(target))
    out = own.join(_small(final), (F.col(names["key"]) == F.col(other_key)) & (F.col(names["k"]) == F.col(other_k)))
    q = (F.col(names["u"]) / (1 - F.col(names["u"]))) / (F.col(f) / (1 - F.col(f)))
    v = q / (1 + q)
    extra = F.when(F.col(f) > 0, F.when(F.col(cut).isNull(), v < F.col(least)).otherwise(v <= F.col(cut)).cast("long")).otherwise(0)
    out = out.withColumn(copies, F.col(whole) + extra)
    if keep:
        return out.select(*map(col, docs.columns), F.col(copies))
    return out.select("doc_id", "source", "size", F.col(source_size).alias("source_size"), F.col(target).alias("target"), F.col(copies).alias("copies"), (F.col(copies) * F.col("size")).alias("taken"), F.col(want).alias("want"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}:' || coalesce(text, '')), 1, 12) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / {1 << 48}::DOUBLE AS u
  FROM documents
), e AS (SELECT *, length(bin(size::BIGINT))::DOUBLE AS k FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS w_all,
         sum(2.0::DOUBLE * source_size) OVER up AS cap_to, sum(w) OVER up AS w_to
  FROM s WINDOW up AS (ORDER BY (2.0::DOUBLE * source_size) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), m AS (SELECT *, cap * (w_all - (w_to - w)) <= w * (total - (cap_to - cap)) AS capped FROM c),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * ((total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / (w_all - sum(CASE WHEN capped THEN w ELSE 0 END) OVER ())) END AS target
  FROM m
), g AS (
  SELECT e.source, e.k, t.target, t.source_size, sum(e.size)::DOUBLE AS n FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source GROUP BY ALL
), h AS (
  SELECT *, k * n AS kn, sum(k * n) OVER (PARTITION BY source) AS kn_all, sum(k * n) OVER up AS kn_to, sum(n) OVER up AS n_to
  FROM g WINDOW up AS (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), i AS (SELECT *, 2.0::DOUBLE * (kn_all - (kn_to - kn)) <= k * (target - 2.0::DOUBLE * (n_to - n)) AS is_full FROM h),
j AS (
  SELECT *, sum(CASE WHEN is_full THEN n ELSE 0 END) OVER (PARTITION BY source) AS n_full, sum(CASE WHEN is_full THEN 0 ELSE kn END) OVER (PARTITION BY source) AS kn_free FROM i
), l AS (
  SELECT *, greatest(CASE WHEN is_full THEN 2.0::DOUBLE WHEN kn_free > 0 THEN least(2.0::DOUBLE, k * ((target - 2.0::DOUBLE * n_full) / kn_free)) ELSE 0.0::DOUBLE END, 0.0::DOUBLE) AS want FROM j
), o AS (SELECT *, floor(want) AS whole, want - floor(want) AS f, target - sum(floor(want) * n) OVER (PARTITION BY source) AS rest FROM l),
r AS (
  SELECT e.doc_id, e.source, e.size, o.source_size, o.target, o.whole, o.rest,
         CASE WHEN f > 0 THEN (u / (1.0::DOUBLE - u)) / (f / (1.0::DOUBLE - f)) END AS q
  FROM e JOIN o ON e.source IS NOT DISTINCT FROM o.source AND e.k = o.k
), v AS (SELECT *, q / (1.0::DOUBLE + q) AS v FROM r),
x AS (
  SELECT *, sum(CASE WHEN v IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY source, v) AS own
  FROM v
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN v IS NOT NULL AND upto - own / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
