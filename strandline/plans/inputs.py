"""The shapes that operators take, derived from whole driver tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alphabets import DNA
from ..functions.scalars import window_weights

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
WIDTH, STATES, SIZE = 3, 3, len(EVENT_TYPES)
PRIOR = [0.5, 0.3, 0.2]
BACKGROUND = [0.3, 0.1, 0.15, 0.2, 0.25]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pos, a: each user's events in order, letters by type."""
    code = F.coalesce(F.element_at(F.create_map(*[x for k, t in enumerate(EVENT_TYPES) for x in (F.lit(t), F.lit(k))]), F.col("event_type")), F.lit(SIZE))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.row_number().over(w) - 1).alias("pos"), code.alias("a"))


EVENTS = "ev AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CASE event_type " + " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(EVENT_TYPES)) + f" ELSE {SIZE} END AS a FROM events)"


def _letter(v: Column) -> Column:
    return F.when(F.abs(v) < 0.02, DNA.gap).when(v < -0.1, 0).when(v < 0.0, 1).when(v < 0.1, 2).otherwise(3)


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ali, k, a: the same with the letters of a row in an array; rows without an entry have no cell."""
    e = table(spark, sf_dir, "embeddings").filter(F.size("embedding") > 0)
    return e.select(F.col("label").alias("ali"), F.col("vec_id").alias("k"), F.transform("embedding", lambda v: _letter(v.cast("double")).cast("tinyint")).alias("a"))


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ali, k, i, a: vectors of a label as aligned sequences; letters by size of the entry, small entries are gaps."""
    a = _letter(F.col("v"))
    cells = table(spark, sf_dir, "embeddings").select(F.col("label").alias("ali"), F.col("vec_id").alias("k"), F.posexplode("embedding").alias("i", "v"))
    return cells.withColumn("v", F.col("v").cast("double")).select("ali", "k", "i", a.alias("a"))


RAW = "raw AS (SELECT label AS ali, vec_id AS k, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"
CELLS0 = RAW + ", cells0 AS (SELECT ali, k, i, CASE WHEN abs(v) < 0.02::DOUBLE THEN 5 WHEN v < -0.1::DOUBLE THEN 0 WHEN v < 0 THEN 1 WHEN v < 0.1::DOUBLE THEN 2 ELSE 3 END AS a FROM raw)"
CELLS = CELLS0 + """, ends AS (SELECT ali, k, min(CASE WHEN a <= 4 THEN i END) AS lo, max(CASE WHEN a <= 4 THEN i END) AS hi FROM cells0 GROUP BY ali, k),
cells AS (SELECT c.ali, c.k, c.i, CASE WHEN a >= 5 AND (lo IS NULL OR i < lo OR i > hi) THEN 6 ELSE a END AS a FROM cells0 c JOIN ends e ON c.ali = e.ali AND c.k = e.k)"""
WEIGHTS = CELLS + """, cnt AS (SELECT ali, i, a, count(*) AS n FROM cells WHERE a < 4 GROUP BY ali, i, a),
dis AS (SELECT ali, i, count(*) AS d FROM cnt GROUP BY ali, i),
len AS (SELECT ali, k, count(*) AS l FROM cells WHERE a < 4 GROUP BY ali, k),
raww AS (SELECT c.ali, c.k, sum(1::DOUBLE / (d * n * l)) AS w FROM cells c JOIN cnt ON c.ali = cnt.ali AND c.i = cnt.i AND c.a = cnt.a JOIN dis ON c.ali = dis.ali AND c.i = dis.i JOIN len ON c.ali = len.ali AND c.k = len.k GROUP BY c.ali, c.k),
gw AS (SELECT x.ali, x.k, coalesce(w / sum(w) OVER (PARTITION BY x.ali), 0) AS w FROM (SELECT DISTINCT ali, k FROM cells) x LEFT JOIN raww ON x.ali = raww.ali AND x.k = raww.k)"""
FREQ = WEIGHTS + """, fs AS (SELECT c.ali, c.i, c.a, sum(w) AS s FROM cells c JOIN gw ON c.ali = gw.ali AND c.k = gw.k WHERE c.a < 4 GROUP BY c.ali, c.i, c.a),
freq AS (SELECT ali, i, a, s / sum(s) OVER (PARTITION BY ali, i) AS f FROM fs)"""
BG4 = [0.3, 0.2, 0.2, 0.3]


def _model() -> list[tuple[int, int, int, float]]:
    out = []
    for k in range(STATES):
        for j in range(WIDTH):
            v = [1 + ((k + 1) * (j + 2) * (a + 1)) % 7 for a in range(SIZE)]
            out += [(k, j, a, x / sum(v)) for a, x in enumerate(v)]
    return out


MODEL = _model()
CENTRAL = [(k, a, p) for k, j, a, p in MODEL if j == (WIDTH - 1) // 2]
WJ = window_weights(WIDTH)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A SQL table expression of numbers; doubles are cast from their shortest text."""
    cell = lambda x: f"CAST('{x!r}' AS DOUBLE)" if isinstance(x, float) else f"'{x}'" if isinstance(x, str) else str(x)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def model(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL, "k int, j int, a int, p double").withColumn("lp", F.ln("p"))


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PRIOR)), "k int, prior double")


def central(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CENTRAL, "k int, a int, p double")


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(WJ)), "j int, w double")


def background(spark: SparkSession, p: list[float] = BACKGROUND) -> DataFrame:
    return spark.createDataFrame(list(enumerate(p)), "a int, p double")


MODEL_SQL = ", ".join([values("model", "k, j, a, p", MODEL), values("state", "k, prior", list(enumerate(PRIOR))), values("wj", "j, w", list(enumerate(WJ))), values("bg", "a, p", list(enumerate(BACKGROUND)))])
_C = (WIDTH - 1) // 2
SCORES = f"""{EVENTS}, {MODEL_SQL},
win AS (SELECT c.id, c.pos, wj.j, x.a FROM ev c JOIN wj ON true JOIN ev x ON x.id = c.id AND x.pos = c.pos + wj.j - {_C}),
score AS (SELECT win.id, win.pos, m.k, sum(ln(m.p) * wj.w) AS s FROM win JOIN model m ON m.j = win.j AND m.a = win.a JOIN wj ON wj.j = win.j GROUP BY win.id, win.pos, m.k),
full_s AS (SELECT id, pos, score.k, s + ln(prior) AS s FROM score JOIN state ON state.k = score.k),
mx AS (SELECT id, pos, max(s) AS m FROM full_s GROUP BY id, pos),
pp AS (SELECT f.id, f.pos, f.k, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY f.id, f.pos) AS pp FROM full_s f JOIN mx ON f.id = mx.id AND f.pos = mx.pos)"""
PREDICTED = SCORES + f""", prs AS (SELECT pp.id, pp.pos, m.a, sum(pp.pp * m.p) AS p FROM pp JOIN model m ON m.k = pp.k AND m.j = {_C} GROUP BY pp.id, pp.pos, m.a),
pc AS (SELECT id, pos, a, p / sum(p) OVER (PARTITION BY id, pos) AS p FROM prs)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query (supplier), target (part), evalue, class: order lines as ranked hits, labels by nation and region."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"), "s_nationkey")
    h = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("price"))
    own, other = F.col("s_nationkey"), F.col("target") % 25
    kind = F.when(own == other, "TP").when(F.floor(own / 5) != F.floor(other / 5), "FP")
    return h.join(s, "query").select("query", "target", "o", "n", "price", F.pow(F.lit(10.0), -F.col("price") / F.lit(10000.0)).alias("evalue"), kind.alias("class"))


HITS = """hits AS (SELECT l_suppkey AS query, l_partkey AS target, l_orderkey AS o, l_linenumber AS n, l_extendedprice AS price, pow(10::DOUBLE, -l_extendedprice / 10000::DOUBLE) AS evalue,
CASE WHEN s_nationkey = l_partkey % 25 THEN 'TP' WHEN s_nationkey // 5 <> (l_partkey % 25) // 5 THEN 'FP' END AS class FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""
HIST = HITS + """, hist AS (SELECT least(29, greatest(0, floor((-log10(evalue) - 0::DOUBLE) / 0.5::DOUBLE)))::INT AS bin, sum(CASE WHEN class = 'TP' THEN 1::DOUBLE ELSE 0 END) AS tp, sum(CASE WHEN class = 'FP' THEN 1::DOUBLE ELSE 0 END) AS fp FROM hits GROUP BY 1)"""
