"""Queries over samples, training sets, labels of families, profiles with their alignments, and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.alphabets import DNA
from ..operators import ranking, sampling, search, sequences
from .catalog import query
from .context_queries import _pp
from .inputs import BACKGROUND, EVENTS, FREQ, MODEL, PRIOR, SCORES, SIZE, embedding_cells, event_cells, r6, table, values

FIRST, DRAW, SEED = 1000, 5, 7


@query(f"SELECT o_orderkey, md5('{SEED}:' || o_orderkey) AS rank_key FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT {FIRST})")
def first_shuffled(spark, sf_dir):
    return sampling.first_shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), FIRST, ["o_orderkey"], ["o_orderkey"], SEED)


POOL = f"pool AS (SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('{SEED}:' || p_partkey), p_partkey) <= {DRAW})"


def _pool(spark, sf_dir):
    return sampling.drawn(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], DRAW, SEED)


@query(f"WITH {POOL} SELECT * FROM pool")
def family_sample(spark, sf_dir):
    return _pool(spark, sf_dir)


@query(f"""WITH {POOL}, p AS (SELECT a.p_brand, a.p_partkey AS x, b.p_partkey AS y, substr(md5('{SEED}:' || a.p_partkey || ':' || b.p_partkey), 1, 1) < '8' AS t FROM pool a JOIN pool b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
SELECT p_brand, CASE WHEN t THEN y ELSE x END AS struct, CASE WHEN t THEN x ELSE y END AS target FROM p""")
def family_pairs(spark, sf_dir):
    return sampling.pool_pairs(_pool(spark, sf_dir), ["p_brand"], "p_partkey", SEED)


LOW, HIGH, STEP, MOST, LEAST, LETTERS = 10, 49, 5, 40, 30, "AACGT"
LENGTHS = f"""sampled AS (SELECT p_partkey, (length(p_name) - {LOW}) // {STEP} AS bin FROM part WHERE length(p_name) BETWEEN {LOW} AND {HIGH}
QUALIFY row_number() OVER (PARTITION BY (length(p_name) - {LOW}) // {STEP} ORDER BY md5('{SEED}:' || p_partkey), p_partkey) <= {MOST})"""


def _by_length(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("seq"))
    return sampling.length_sample(p, ["p_partkey"], LOW, HIGH, STEP, MOST, seed=SEED)


@query(f"WITH {LENGTHS} SELECT p_partkey, bin::INT AS bin FROM sampled")
def length_sample(spark, sf_dir):
    return _by_length(spark, sf_dir).select("p_partkey", "bin")


@query(f"""WITH {LENGTHS}, b AS (SELECT unnest(range(0, {(HIGH - LOW) // STEP + 1})) AS bin), h AS (SELECT bin, count(*) AS n FROM sampled GROUP BY bin),
t AS (SELECT bin, unnest(range(coalesce(n, 0), {LEAST})) AS turn FROM b LEFT JOIN h USING (bin))
SELECT bin::INT AS bin, 'x' || substr(md5('{SEED}:' || bin || ':' || turn), 1, 6) AS tag, list_aggregate(list_transform(range(1, bin * {STEP} + {LOW} + 1), lambda k: substr('{LETTERS}', (('0x' || substr(md5('{SEED}:' || bin || ':' || turn || ':' || k), 1, 7))::BIGINT % {len(LETTERS)})::INT + 1, 1)), 'string_agg', '') AS seq FROM t""")
def length_fill(spark, sf_dir):
    return sampling.length_fill(_by_length(spark, sf_dir), LETTERS, LOW, HIGH, STEP, LEAST, SEED)


@query("SELECT round(avg(abs(embedding[(len(embedding) - 1) // 2 + 1]::DOUBLE) + 1), 6) + 0 AS neff_x, round(avg(list_sum(list_transform(embedding[1:4], lambda v: abs(v::DOUBLE)))), 6) + 0 AS neff_y FROM embeddings")
def training_neff(spark, sf_dir):
    e = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    t = table(spark, sf_dir, "embeddings").select(F.transform(e, lambda v: v + F.lit(1.0)).alias("x_neff"), F.slice(e, 1, 4).alias("y"))
    return sampling.training_neff(t).select(r6(F.col("neff_x")).alias("neff_x"), r6(F.col("neff_y")).alias("neff_y"))


CELL_COUNT = len(PRIOR) * (SIZE + 1)


@query(f"""WITH {SCORES}, {EVENTS.replace('ev AS', 'ev2 AS')}, n AS (SELECT pp.k, ev2.a AS s, sum(pp.pp) AS n FROM pp JOIN ev2 ON ev2.id = pp.id AND ev2.pos = pp.pos + 1 GROUP BY 1, 2)
SELECT round(sum(n), 4) + 0 AS total, round(CASE WHEN count(*) < {CELL_COUNT} THEN 0 ELSE min(n) END, 4) + 0 AS least, round(max(n), 4) + 0 AS most, round(sum(n) / {CELL_COUNT}, 4) + 0 AS mean FROM n""")
def substitution_statistics(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    n = F.lead("pos").over(Window.partitionBy("id").orderBy("pos"))
    pairs = e.select(F.col("id").alias("query"), (-F.col("id") - 1).alias("target"), F.col("pos").alias("i"), n.alias("j"), F.lit(1.0).alias("confidence")).filter("j is not null")
    counts = sequences.state_substitutions(pairs, _pp(spark, sf_dir), e.select((-F.col("id") - 1).alias("id"), "pos", F.col("a").alias("s")))
    got = sampling.count_statistics(counts, CELL_COUNT)
    return got.select(*[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("total", "least", "most", "mean")])


@query("""WITH a AS (SELECT l_orderkey, count(*) AS matches FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
SELECT o_orderkey::VARCHAR AS name, o_orderkey % 7 + 1 AS columns, matches, coalesce(o_orderkey % 7 + 1 = matches, false) AS fits FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")
def profile_alignments(spark, sf_dir):
    """Orders as profiles and their lines as match columns; a fifth of the orders has no alignment."""
    p = table(spark, sf_dir, "orders").select(F.format_string("profiles/%s.prf", F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") % 7 + 1).alias("columns"))
    a = table(spark, sf_dir, "lineitem").filter("l_orderkey % 5 != 0").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("matches"))
    return sampling.with_alignments(p, a.select(F.format_string("alignments/%s.a3m", F.col("l_orderkey").cast("string")).alias("path"), "matches"))


FAMILIES = ("a.118.24", "a.1.2", "b.66", "b.70", "c.2", "c.111", "d.58.1", "d.211.1", "i.1", "g.3")


def _label(key: str) -> str:
    names = ", ".join(f"'{x}'" for x in FAMILIES)
    return f"{{pick}}([{names}], CAST({key} % {len(FAMILIES)} AS INT) + 1) || '.' || CAST({key} % 3 AS VARCHAR) || '.' || CAST({key} % 4 AS VARCHAR)"


def _matches(x: str) -> str:
    return f"(regexp_matches(q, '{x}') AND regexp_matches(t, '{x}'))"


@query(f"""WITH l AS (SELECT {_label('l_partkey').format(pick='list_extract')} AS q, {_label('l_suppkey').format(pick='list_extract')} AS t FROM lineitem),
x AS (SELECT *, regexp_matches(q, '{ranking.UNSURE}') OR regexp_matches(t, '{ranking.UNSURE}') OR {' OR '.join(map(_matches, ranking.RELATED))} AS e,
CASE WHEN split_part(q, '.', 1) <> split_part(t, '.', 1) THEN 0 WHEN split_part(q, '.', 2) <> split_part(t, '.', 2) THEN 1 WHEN split_part(q, '.', 3) <> split_part(t, '.', 3) THEN 2 WHEN split_part(q, '.', 4) <> split_part(t, '.', 4) THEN 3 ELSE 4 END AS rel FROM l)
SELECT q, t, CASE WHEN rel >= 3 THEN 'TP' WHEN rel <= 1 AND NOT e THEN 'FP' END AS kind, count(*) AS n FROM x GROUP BY 1, 2, 3""")
def family_classes(spark, sf_dir):
    """Classes of pairs of labels with the families whose unlike labels may be related."""
    li = table(spark, sf_dir, "lineitem")

    def label(key):
        names = F.array(*map(F.lit, FAMILIES))
        return F.concat(F.element_at(names, (F.col(key) % len(FAMILIES)).cast("int") + 1), F.lit("."), (F.col(key) % 3).cast("string"), F.lit("."), (F.col(key) % 4).cast("string"))

    p = li.groupBy(label("l_partkey").alias("q"), label("l_suppkey").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    kind = ranking.classified(ranking.relation(F.col("q"), F.col("t")), excepted=ranking.excepted(F.col("q"), F.col("t")))
    return p.select("q", "t", kind.alias("kind"), "n")


@query(f"WITH {FREQ} SELECT ali AS id, i AS pos, a, round(f, 6) + 0 AS p FROM freq")
def profile_build(spark, sf_dir):
    """Profiles of whole alignments with weights of rows."""
    p = search.alignment_profile(embedding_cells(spark, sf_dir), DNA, search.SearchOptions(global_weights=True))
    return p.select("id", "pos", "a", r6(F.col("p")).alias("p"))


BITS = [(k, j, a, p, BACKGROUND[a]) for k, j, a, p in MODEL]


@query(f"""WITH {EVENTS}, {values('bits', 'query, i, a, p, bg', BITS)}, d AS (SELECT query, id AS target, pos - i AS diagonal, i, log2(p / bg) AS s FROM ev JOIN bits USING (a)),
r AS (SELECT *, sum(s) OVER w AS run FROM d WINDOW w AS (PARTITION BY query, target, diagonal ORDER BY i)),
g AS (SELECT *, run - least(0, coalesce(min(run) OVER (PARTITION BY query, target, diagonal ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gain FROM r)
SELECT query, target, diagonal, round(max(gain), 6) + 0 AS score FROM g GROUP BY 1, 2, 3 HAVING max(gain) > 0""")
def scan_hits(spark, sf_dir):
    """Best segments of the model's windows as profiles on all sequences of events."""
    profile = spark.createDataFrame([(k, j, a, p) for k, j, a, p, _ in BITS], "id int, pos int, a int, p double")
    bits = search.log_odds_bits(profile, spark.createDataFrame(list(enumerate(BACKGROUND)), "a int, p double"))
    found = search.scan(bits, event_cells(spark, sf_dir).filter(F.col("a") < SIZE).withColumnRenamed("id", "target"))
    return found.select("query", "target", "diagonal", r6(F.col("score")).alias("score"))
