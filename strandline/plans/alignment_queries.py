"""Queries over sequences, alignments and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alphabets, scalars
from ..functions.alphabets import AA, DNA
from ..operators import alignments, profiles, sequences
from .catalog import query
from .inputs import BG4, CELLS, CELLS0, EVENTS, FREQ, WEIGHTS, background, embedding_cells, event_cells, r6, table, values


def _cells(spark, sf_dir):
    return alignments.mark_end_gaps(embedding_cells(spark, sf_dir), DNA)


def _weighted(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return c, alignments.global_weights(c, DNA)


def _freq(spark, sf_dir):
    c, w = _weighted(spark, sf_dir)
    return alignments.weighted_frequencies(c, w, DNA)


def _count_sql() -> str:
    by: dict[int, str] = {}
    for c, k in AA.codes().items():
        if k <= AA.any:
            by[k] = by.get(k, "") + c
    parts = [f"SELECT lang, {k} AS a, sum(length(t) - length(translate(t, '{chars}', '')))::BIGINT AS n FROM u GROUP BY lang" for k, chars in sorted(by.items())]
    return "WITH u AS (SELECT lang, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS t FROM documents WHERE text IS NOT NULL) SELECT * FROM (" + " UNION ALL ".join(parts) + ")"


@query(_count_sql())
def seq_encode_counts(spark, sf_dir):
    return sequences.letter_totals(table(spark, sf_dir, "documents").filter("text is not null"), "lang", "text", AA)


@query("SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(text, '[ARNDCQEGHILKMFPSTWYVBZUJOXarndcqeghilkmfpstwyvbzujox\\-\\.]|\\s', '', 'g')) AS invalid FROM documents")
def seq_validity(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("long").alias("letters"), F.length(F.regexp_replace("text", f"{AA.valid_pattern()}|\\s", "")).cast("long").alias("invalid"))


@query(f"WITH {CELLS} SELECT ali, i, sum(CASE WHEN a = 5 THEN 1 ELSE 0 END)::BIGINT AS gaps, sum(CASE WHEN a = 6 THEN 1 ELSE 0 END)::BIGINT AS end_gaps FROM cells GROUP BY ali, i")
def ali_endgap_mask(spark, sf_dir):
    c = _cells(spark, sf_dir)
    n = lambda k: F.sum((F.col("a") == k).cast("long"))
    return c.groupBy("ali", "i").agg(n(DNA.gap).alias("gaps"), n(DNA.end_gap).alias("end_gaps"))


@query(f"WITH {CELLS} SELECT ali, i, a, count(*) AS n FROM cells WHERE a < 4 GROUP BY ali, i, a")
def ali_residue_counts(spark, sf_dir):
    return alignments.letter_counts(_cells(spark, sf_dir), DNA)


@query(f"WITH {CELLS} SELECT ali, i, count(DISTINCT a) AS d FROM cells WHERE a < 4 GROUP BY ali, i")
def ali_distinct_residues(spark, sf_dir):
    return alignments.distinct_letters(alignments.letter_counts(_cells(spark, sf_dir), DNA))


@query(f"WITH {WEIGHTS} SELECT ali, k, round(w, 6) + 0 AS w FROM gw")
def ali_global_weights(spark, sf_dir):
    return _weighted(spark, sf_dir)[1].select("ali", "k", r6(F.col("w")).alias("w"))


NEFF = FREQ + ", nf AS (SELECT l.ali, pow(2::DOUBLE, coalesce(h, 0) / n) AS neff FROM (SELECT ali, count(DISTINCT i) AS n FROM cells GROUP BY ali) l LEFT JOIN (SELECT ali, -sum(CASE WHEN f > 1e-10 THEN f * log2(f) ELSE 0 END) AS h FROM freq GROUP BY ali) x ON l.ali = x.ali)"


@query(f"WITH {NEFF} SELECT ali, round(neff, 6) + 0 AS neff FROM nf")
def ali_neff(spark, sf_dir):
    c, w = _weighted(spark, sf_dir)
    return alignments.diversity(c, w, DNA).select("ali", r6(F.col("neff")).alias("neff"))


@query(f"WITH {FREQ} SELECT q.ali, round(avg(n + 1 - n * q), 6) + 0 AS neff FROM (SELECT ali, i, sum(f * f) AS q FROM freq GROUP BY ali, i) q JOIN (SELECT ali, count(DISTINCT k)::DOUBLE AS n FROM cells GROUP BY ali) c ON c.ali = q.ali GROUP BY q.ali")
def ali_neff_sop(spark, sf_dir):
    c, w = _weighted(spark, sf_dir)
    return alignments.diversity(c, w, DNA, pairs=True).select("ali", r6(F.col("neff")).alias("neff"))


@query(f"WITH {NEFF} SELECT freq.ali, i, a, round(f * neff, 6) + 0 AS v FROM freq JOIN nf ON nf.ali = freq.ali")
def ali_profile_cells(spark, sf_dir):
    c, w = _weighted(spark, sf_dir)
    return alignments.count_profile(c, w, alignments.diversity(c, w, DNA), DNA).select("ali", "i", "a", r6(F.col("v")).alias("v"))


POSITION = WEIGHTS + """, mem AS (SELECT ali, i, k FROM cells WHERE a < 4), m AS (SELECT ali, i, count(*) AS m FROM mem GROUP BY ali, i),
sub AS (SELECT mem.ali, mem.i, mem.k, c.i AS j, c.a FROM mem JOIN cells c ON c.ali = mem.ali AND c.k = mem.k),
sc AS (SELECT ali, i, j, a, count(*) AS n FROM sub GROUP BY ali, i, j, a),
col AS (SELECT sc.ali, sc.i, j, sum(CASE WHEN a < 4 THEN 1 ELSE 0 END) AS d FROM sc JOIN m ON m.ali = sc.ali AND m.i = sc.i GROUP BY sc.ali, sc.i, j, m HAVING sum(CASE WHEN a = 6 THEN n ELSE 0 END) <= 0.1::DOUBLE * m),
ncol AS (SELECT ali, i, count(*) AS ncol FROM col WHERE d > 0 GROUP BY ali, i),
rw AS (SELECT s.ali, s.i, s.k, sum(1::DOUBLE / (n * d)) AS w FROM sub s JOIN sc ON sc.ali = s.ali AND sc.i = s.i AND sc.j = s.j AND sc.a = s.a JOIN col ON col.ali = s.ali AND col.i = s.i AND col.j = s.j WHERE s.a < 4 AND d > 0 GROUP BY s.ali, s.i, s.k),
pw AS (SELECT mem.ali, mem.i, mem.k, coalesce(ncol, 0) AS ncol, CASE WHEN coalesce(ncol, 0) < 10 THEN gw.w ELSE coalesce(rw.w / sum(rw.w) OVER (PARTITION BY mem.ali, mem.i), 0) END AS w
  FROM mem LEFT JOIN rw ON rw.ali = mem.ali AND rw.i = mem.i AND rw.k = mem.k LEFT JOIN ncol ON ncol.ali = mem.ali AND ncol.i = mem.i JOIN gw ON gw.ali = mem.ali AND gw.k = mem.k),
ps AS (SELECT s.ali, s.i, ncol, s.j, s.a, sum(w) AS s FROM sub s JOIN col ON col.ali = s.ali AND col.i = s.i AND col.j = s.j JOIN pw ON pw.ali = s.ali AND pw.i = s.i AND pw.k = s.k WHERE s.a < 4 GROUP BY s.ali, s.i, ncol, s.j, s.a),
pf AS (SELECT ali, i, ncol, j, a, CASE WHEN sum(s) OVER (PARTITION BY ali, i, j) > 0 THEN s / sum(s) OVER (PARTITION BY ali, i, j) ELSE 0 END AS f FROM ps),
pn AS (SELECT ali, i, pow(2::DOUBLE, -sum(CASE WHEN f > 1e-10 THEN f * log2(f) ELSE 0 END) / max(ncol)) AS neff FROM pf GROUP BY ali, i)"""


@query(f"WITH {POSITION} SELECT ali, i, k, round(w, 6) + 0 AS w FROM pw")
def ali_position_weights(spark, sf_dir):
    w, _ = alignments.position_weights(_cells(spark, sf_dir), DNA)
    return w.select("ali", "i", "k", r6(F.col("w")).alias("w"))


@query(f"WITH {POSITION} SELECT ali, i, round(neff, 6) + 0 AS neff FROM pn")
def ali_position_neff(spark, sf_dir):
    _, n = alignments.position_weights(_cells(spark, sf_dir), DNA)
    return n.select("ali", "i", r6(F.col("neff")).alias("neff"))


@query(f"WITH {WEIGHTS} SELECT c.ali, c.i, coalesce(100::DOUBLE * sum(CASE WHEN a = 5 THEN w ELSE 0 END) / nullif(sum(CASE WHEN a <> 6 THEN w ELSE 0 END), 0) <= 15, false) AS is_match FROM cells c JOIN gw ON gw.ali = c.ali AND gw.k = c.k GROUP BY c.ali, c.i")
def match_columns_by_gap(spark, sf_dir):
    c, w = _weighted(spark, sf_dir)
    return alignments.match_by_gaps(c, w, DNA, 15.0)


def _references(c):
    """Rows numbered within their alignment, the first one as the reference."""
    from pyspark.sql import Window

    ranks = c.select("ali", "k").distinct().withColumn("r", (F.row_number().over(Window.partitionBy("ali").orderBy("k")) - 1).cast("int"))
    return c.join(ranks, ["ali", "k"]).drop("k").withColumnRenamed("r", "k")


REFERENCE = CELLS + """, rk AS (SELECT ali, k, row_number() OVER (PARTITION BY ali ORDER BY k) - 1 AS r FROM (SELECT DISTINCT ali, k FROM cells)),
rc AS (SELECT c.ali, rk.r AS k, c.i, c.a FROM cells c JOIN rk ON rk.ali = c.ali AND rk.k = c.k),
mt AS (SELECT ali, i, a <= 4 AS is_match FROM rc WHERE k = 0)"""


@query(f"WITH {REFERENCE} SELECT rc.ali, sum(CASE WHEN is_match THEN 1 ELSE 0 END)::BIGINT AS match_cells, sum(CASE WHEN (CASE WHEN NOT is_match AND k <> 0 THEN 5 ELSE a END) = 5 THEN 1 ELSE 0 END)::BIGINT AS gaps FROM rc JOIN mt ON mt.ali = rc.ali AND mt.i = rc.i GROUP BY rc.ali")
def match_columns_by_reference(spark, sf_dir):
    c = alignments.blank_inserts(alignments.match_by_reference(_references(_cells(spark, sf_dir)), DNA), DNA)
    return c.groupBy("ali").agg(F.sum(F.col("is_match").cast("long")).alias("match_cells"), F.sum((F.col("a") == DNA.gap).cast("long")).alias("gaps"))


@query(f"WITH {REFERENCE}, n AS (SELECT ali, i, row_number() OVER (PARTITION BY ali ORDER BY i) - 1 AS m FROM mt WHERE is_match) SELECT rc.ali, rc.k, m AS i, a FROM rc JOIN n ON n.ali = rc.ali AND n.i = rc.i")
def ali_without_inserts(spark, sf_dir):
    c = alignments.match_by_reference(_references(_cells(spark, sf_dir)), DNA)
    return alignments.without_inserts(c).select("ali", "k", "i", "a")


@query("""WITH r AS (SELECT lang AS ali, md5(text) AS header, source >= 'src5' AS half, row_number() OVER (PARTITION BY lang, source >= 'src5' ORDER BY doc_id) - 1 AS k FROM documents),
m AS (SELECT * FROM r WHERE NOT half), o AS (SELECT * FROM r x WHERE half AND NOT EXISTS (SELECT 1 FROM m WHERE m.ali = x.ali AND m.header = x.header))
SELECT ali, k, header FROM m UNION ALL SELECT o.ali, coalesce(b, 0) + row_number() OVER (PARTITION BY o.ali ORDER BY o.k) - 1 AS k, header FROM o LEFT JOIN (SELECT ali, max(k) + 1 AS b FROM m GROUP BY ali) x ON x.ali = o.ali""")
def ali_merge_new_headers(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("ali"), F.md5("text").alias("header"), (F.col("source") >= "src5").alias("half"), "doc_id")
    d = d.withColumn("k", (F.row_number().over(Window.partitionBy("ali", "half").orderBy("doc_id")) - 1).cast("long"))
    return alignments.merged(d.filter("not half").select("ali", "k", "header"), d.filter("half").select("ali", "k", "header"))


@query("SELECT source AS ali, dense_rank() OVER (PARTITION BY source ORDER BY md5(text)) - 1 AS k, doc_id FROM documents")
def ali_rearrange(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select(F.col("source").alias("ali"), F.md5("text").alias("header"), "doc_id", F.lit(0).alias("k"))
    order = d.select("ali", "header").distinct().withColumn("rank", (F.row_number().over(Window.partitionBy("ali").orderBy("header")) - 1).cast("long"))
    return alignments.rearranged(d, order).select("ali", "k", "doc_id")


BG_SQL = values("b4", "a, p", list(enumerate(BG4)))


@query(f"WITH {FREQ}, {BG_SQL}, x AS (SELECT ali, i, freq.a, f - p AS d, row_number() OVER (PARTITION BY ali, i ORDER BY f - p DESC, freq.a) AS r FROM freq JOIN b4 ON b4.a = freq.a) SELECT ali, i, CASE WHEN d > 0 THEN a ELSE 0 END AS code FROM x WHERE r = 1")
def profile_consensus(spark, sf_dir):
    return profiles.consensus(_freq(spark, sf_dir), background(spark, BG4), ["ali", "i"])


JOINT = [(a, b, (0.15 if a == b else 0.4 / 12)) for a in range(4) for b in range(4)]


@query(f"""WITH {FREQ}, {BG_SQL}, {values('q', 'a, b, q', JOINT)}, x AS (SELECT ali, i, freq.a, row_number() OVER (PARTITION BY ali, i ORDER BY f - p DESC, freq.a) AS r FROM freq JOIN b4 ON b4.a = freq.a),
t AS (SELECT ali, i, a AS m FROM x WHERE r = 1), sim AS (SELECT q.a, q.b, q.q * q.q / (qa.q * qb.q) AS s FROM q JOIN q qa ON qa.a = q.a AND qa.b = q.a JOIN q qb ON qb.a = q.b AND qb.b = q.b),
sc AS (SELECT freq.ali, freq.i, m, sum(f * s * s) AS score FROM freq JOIN t ON t.ali = freq.ali AND t.i = freq.i JOIN sim ON sim.a = m AND sim.b = freq.a GROUP BY freq.ali, freq.i, m)
SELECT ali, i, m AS code, round(score, 6) + 0 AS score, CASE WHEN score > 0.6::DOUBLE THEN 'U' WHEN score > 0.4::DOUBLE THEN 'L' ELSE '~' END AS mark FROM sc""")
def profile_conservation(spark, sf_dir):
    m, _ = profiles.from_joint(spark.createDataFrame(JOINT, "a int, b int, q double"))
    return profiles.conservation(_freq(spark, sf_dir), background(spark, BG4), m, ["ali", "i"]).withColumn("score", r6(F.col("score")))


@query(f"""WITH {FREQ}, {BG_SQL}, s AS (SELECT ali, i, ln(sum(f * f / p)) / ln(sum(f / p)) AS s FROM freq JOIN b4 ON b4.a = freq.a GROUP BY ali, i)
SELECT ali, i, round(s, 6) + 0 AS score, round((s - avg(s) OVER (PARTITION BY ali)) / stddev_samp(s) OVER (PARTITION BY ali), 5) + 0 AS z FROM s""")
def profile_conservation_z(spark, sf_dir):
    s = profiles.conservation_scores(_freq(spark, sf_dir), background(spark, BG4), "ali")
    return s.select("ali", "i", r6(F.col("score")).alias("score"), (F.round("z", 5) + F.lit(0.0)).alias("z"))


@query(f"WITH {FREQ}, h AS (SELECT ali, i, -sum(CASE WHEN f > 1.17549435e-38 THEN f * log2(f) ELSE 0 END) AS h FROM freq GROUP BY ali, i) SELECT freq.ali, freq.i, a, round(f * (2 - h), 6) + 0 AS height FROM freq JOIN h ON h.ali = freq.ali AND h.i = freq.i")
def profile_logo(spark, sf_dir):
    return profiles.logo(_freq(spark, sf_dir), DNA, ["ali", "i"]).select("ali", "i", "a", r6(F.col("height")).alias("height"))


@query("""WITH c AS (SELECT user_id AS id, event_type AS a, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), f AS (SELECT id, n / sum(n) OVER (PARTITION BY id) AS f FROM c)
SELECT id, round(pow(2::DOUBLE, -sum(f * log2(f))), 6) + 0 AS neff FROM f GROUP BY id""")
def profile_entropy_neff(spark, sf_dir):
    c = event_cells(spark, sf_dir).groupBy("id", "a").agg(F.count(F.lit(1)).cast("double").alias("v")).withColumn("i", F.lit(0))
    return scalars.profile_neff(scalars.scaled_to_one(c, ["id", "i"]), "id").select("id", r6(F.col("neff")).alias("neff"))


@query("""WITH g AS (SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT f, s, round(CASE WHEN abs(100 - sum(v) OVER (PARTITION BY f)) > 1e-6 AND sum(v) OVER (PARTITION BY f) <> 0 THEN v * 100::DOUBLE / sum(v) OVER (PARTITION BY f) ELSE v END, 6) + 0 AS v FROM g""")
def profile_normalize(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).agg(F.sum("l_quantity").alias("v"))
    return scalars.normalized(g, ["f"], "v", 100.0).select("f", "s", r6(F.col("v")).alias("v"))


PAIRS = EVENTS + """, pr AS (SELECT x.a, y.a AS b FROM ev x JOIN ev y ON y.id = x.id AND y.pos = x.pos + 1), j AS (SELECT a, b, count(*)::DOUBLE AS n FROM (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr) GROUP BY a, b),
q AS (SELECT a, b, n / sum(n) OVER () AS q FROM j), px AS (SELECT a, sum(q) AS p FROM q GROUP BY a)"""


def _event_matrix(spark, sf_dir):
    from pyspark.sql import Window

    c = event_cells(spark, sf_dir).withColumn("b", F.lead("a").over(Window.partitionBy("id").orderBy("pos"))).filter("b is not null").select("a", "b")
    q = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("q"))
    return profiles.from_joint(q)


@query(f"WITH {PAIRS} SELECT q.a, q.b, round(q, 6) + 0 AS q, round(q / y.p, 6) + 0 AS rx, round(q / x.p, 6) + 0 AS ry, round(log2(q / (x.p * y.p)), 6) + 0 AS s FROM q JOIN px x ON x.a = q.a JOIN px y ON y.a = q.b")
def submat_from_pairs(spark, sf_dir):
    m, _ = _event_matrix(spark, sf_dir)
    return m.select("a", "b", *[r6(F.col(c)).alias(c) for c in ("q", "rx", "ry", "s")])


@query(f"WITH {PAIRS} SELECT round(sum(p * pow(2::DOUBLE, h)), 6) + 0 AS neff FROM (SELECT q.b, max(px.p) AS p, -sum(q / p * log2(q / p)) AS h FROM q JOIN px ON px.a = q.b GROUP BY q.b)")
def submat_neff(spark, sf_dir):
    m, b = _event_matrix(spark, sf_dir)
    return profiles.matrix_neff(m, b).select(r6(F.col("neff")).alias("neff"))


@query(f"WITH {PAIRS}, c AS (SELECT id, a, count(*)::DOUBLE AS n FROM ev GROUP BY id, a), f AS (SELECT id, a, n / sum(n) OVER (PARTITION BY id) AS f FROM c) SELECT id, q.a, round(sum(q / p * f), 6) + 0 AS p FROM f JOIN q ON q.b = f.a JOIN px ON px.a = q.b GROUP BY id, q.a")
def matrix_pseudocounts(spark, sf_dir):
    m, _ = _event_matrix(spark, sf_dir)
    c = event_cells(spark, sf_dir).groupBy("id", "a").agg(F.count(F.lit(1)).cast("double").alias("f"))
    return profiles.matrix_predicted(scalars.scaled_to_one(c, ["id"], "f"), m, ["id"]).select("id", "a", r6(F.col("p")).alias("p"))


@query(f"WITH {CELLS0} SELECT ali, k, string_agg(substr('ACGTN', a + 1, 1), '' ORDER BY i) AS seq FROM cells0 WHERE a <= 4 GROUP BY ali, k")
def ali_ungapped_sequences(spark, sf_dir):
    s = alignments.sequence_of(embedding_cells(spark, sf_dir), DNA)
    return s.select("ali", "k", F.array_join(F.transform("letters", lambda a: alphabets.decoded(a, DNA)), "").alias("seq"))
