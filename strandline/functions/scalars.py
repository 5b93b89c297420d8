"""Column functions over profiles in cell form (id, i, a, v) and over scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sums nearer to their goal than this are not rescaled; probabilities below FLT_MIN add nothing to an entropy.
TOLERANCE, FLT_MIN, TINY = 1e-6, 1.17549435e-38, 2.2250738585072014e-308


def iround(x: Column) -> Column:
    """floor(x + 0.5), also for negative numbers."""
    return F.floor(x + F.lit(0.5))


def plogp(p: Column) -> Column:
    return F.when(p > F.lit(FLT_MIN), p * F.log2(p)).otherwise(F.lit(0.0))


def normalized(df: DataFrame, by: list[str], v: str = "v", goal: Column | float = 1.0, tolerance: float = TOLERANCE) -> DataFrame:
    """v scaled so that each group sums to goal; groups that sum to 0 or are near enough stay as they are."""
    goal = goal if isinstance(goal, Column) else F.lit(float(goal))
    s = F.sum(v).over(Window.partitionBy(*by))
    return df.withColumn(v, F.when((F.abs(goal - s) > F.lit(tolerance)) & (s != F.lit(0.0)), F.col(v) * goal / s).otherwise(F.col(v)))


def scaled_to_one(df: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """v over the sum of its group, always; a zero sum gives 0."""
    s = F.sum(v).over(Window.partitionBy(*by))
    return df.withColumn(v, F.when(s != F.lit(0.0), F.col(v) / s).otherwise(F.lit(0.0)))


def frequency(count: Column, neff: Column) -> Column:
    return F.when(neff > F.lit(0.0), count / neff).otherwise(F.lit(0.0))


def column_entropy(cells: DataFrame, keys: list[str], v: str = "v", size: int | None = None) -> DataFrame:
    """keys, h: entropy in bits of each column; codes from size on (any letter) are left out."""
    own = cells if size is None else cells.filter(F.col("a") < size)
    return own.groupBy(*keys).agg((-F.sum(plogp(F.col(v)))).alias("h"))


def profile_neff(cells: DataFrame, id_col: str = "id", pos: str = "i", v: str = "v", size: int | None = None) -> DataFrame:
    """id, neff: 2 to the mean column entropy of normalised columns."""
    h = column_entropy(cells, [id_col, pos], v, size)
    return h.groupBy(id_col).agg(F.pow(F.lit(2.0), F.sum("h") / F.count(F.lit(1))).alias("neff"))


def count_profile_neff(columns: DataFrame, id_col: str = "id") -> DataFrame:
    """id, neff: the mean of the columns' own numbers."""
    return columns.groupBy(id_col).agg(F.avg("neff").alias("neff"))


def subprofile(cells: DataFrame, start: int, length: int, pos: str = "i") -> DataFrame:
    """The window [start, start + length), positions from 0."""
    return cells.filter((F.col(pos) >= start) & (F.col(pos) < start + length)).withColumn(pos, F.col(pos) - start)


def subsequence(seq: Column, start: int, length: int) -> Column:
    return F.substring(seq, start + 1, length)


def inserted(cells: DataFrame, other: DataFrame, offset: int, id_col: str = "id", pos: str = "i", v: str = "v") -> DataFrame:
    """cells with the columns of other (same ids) put at offset, clipped at the ends."""
    put = other.select(id_col, (F.col(pos) + offset).alias(pos), "a", F.col(v).alias("_new"))
    return cells.join(put, [id_col, pos, "a"], "left").withColumn(v, F.coalesce("_new", v)).drop("_new")


def to_log(cells: DataFrame, v: str = "v") -> DataFrame:
    return cells.withColumn(v, F.ln(v))


def to_linear(cells: DataFrame, v: str = "v") -> DataFrame:
    return cells.withColumn(v, F.exp(v))


def shifted(v: Column, bits: float) -> Column:
    return v * F.lit(2.0**bits)


def log_odds(p: Column, background: Column) -> Column:
    return F.ln(p / background)


def window_weights(width: int, center: float = 1.6, decay: float = 0.85) -> list[float]:
    """center * decay ** distance for each offset of a window of odd width."""
    if width % 2 == 0:
        raise ValueError("a window has an odd width")
    c = (width - 1) // 2
    return [center * decay ** abs(j - c) for j in range(width)]


def match_symbol(pp: Column) -> Column:
    return F.when(pp > F.lit(0.8), "|").when(pp > F.lit(0.6), "+").when(pp > F.lit(0.4), ".").when(pp > F.lit(0.2), "-").otherwise("=")


def confidence_digit(pp: Column) -> Column:
    return F.floor((pp - F.lit(2.220446049250313e-16)) * F.lit(10.0)).cast("int")


def colour_text(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("%4.2f,%4.2f,%4.2f", r, g, b)


def parsed_colour(text: Column) -> Column:
    part = F.split(text, ",")
    return F.struct(*[F.trim(part[k]).cast("double").alias(n) for k, n in enumerate("rgb")])


# Letters of names of lattice cells.
VOWELS, CONSONANTS = "AEIOUY", "BCDFGH"


def lattice_name(red: Column, green: Column, blue: Column, side: int, number: Column) -> Column:
    """Vowel, consonant, vowel of a cell of a cube of the given side (red, green, blue from 0), and a running number."""
    pick = lambda letters, k: F.element_at(F.array(*map(F.lit, letters)), (F.lit(side) - k).cast("int"))
    return F.concat(pick(VOWELS, red), pick(CONSONANTS, green), pick(VOWELS, blue), number.cast("string"))


def relative_difference(a: Column, b: Column) -> Column:
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == F.lit(0.0), F.lit(0.0)).otherwise(F.abs(a - b) / top)


def p_from_e(e: Column, n: Column) -> Column:
    return F.lit(1.0) - F.exp(-e / n)


def e_from_p(p: Column, n: Column) -> Column:
    return -n * F.ln(F.lit(1.0) - p)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The name of a file without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"\.([^.]*)$", 1)


def tokens(text: Column, separator: str = r"\s+") -> Column:
    return F.filter(F.split(text, separator), lambda x: x != "")


def trapezoid(points: DataFrame, by: list[str], x: str = "x", y: str = "y", start: tuple[float, float] | None = None) -> DataFrame:
    """by, area under the points in order of x; with start the curve begins there, else at its first point."""
    w = Window.partitionBy(*by).orderBy(x, y) if by else Window.partitionBy(F.lit(0)).orderBy(x, y)
    px, py = F.lag(x).over(w), F.lag(y).over(w)
    if start is not None:
        px, py = F.coalesce(px, F.lit(start[0])), F.coalesce(py, F.lit(start[1]))
    p = points.withColumns({"_dx": F.col(x) - px, "_my": (F.col(y) + py) / F.lit(2.0)})
    return (p.groupBy(*by) if by else p).agg(F.sum(F.coalesce(F.col("_dx") * F.col("_my"), F.lit(0.0))).alias("area"))
