"""Writers of the text and binary formats; each takes DataFrames and a path and writes through Spark.

Functions that end in `_text` return one row for each record with its text, so that they can be
written, appended or compared; `write_text` writes such rows.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabets import Alphabet
from ..functions.scalars import iround

SCALE = 1000.0


def write_text(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record a row; mode append adds to what is there."""
    rows.select("value").write.mode(mode).text(path)


def wrapped(seq: Column, width: int = 100) -> Column:
    """seq with a line break behind every width characters."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def fasta_text(seqs: DataFrame, header: str = "header", seq: str = "seq", width: int = 100) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), wrapped(F.col(seq), width)).alias("value"))


def alignment_text(rows: DataFrame, form: str = "fasta", width: int = 100) -> DataFrame:
    """Rows (name, k, header, row) of alignments as one text each, in fasta, a2m, a3m, psi or clustal form."""
    if form in ("psi", "clustal"):
        return _block_text(rows, form, 60)
    row = {"fasta": F.translate(F.upper("row"), ".", "-"), "a2m": F.col("row"), "a3m": F.regexp_replace("row", r"\.", "")}[form]
    one = rows.select("name", "k", F.concat(F.lit(">"), "header", F.lit("\n"), wrapped(row, width)).alias("t"))
    return one.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n").alias("t")).select(F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("#"), "name", F.lit("\n"), "t")).otherwise(F.col("t")).alias("value"))


def _block_text(rows: DataFrame, form: str, width: int) -> DataFrame:
    label = F.rpad(F.regexp_extract("header", r"^(\S*)", 1), 33 if form == "psi" else 18, " ")
    cut = rows.select("name", "k", label.alias("label"), F.translate(F.upper("row"), ".", "-").alias("row")).select("name", "k", "label", "row", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("row") - 1), F.lit(width))).alias("at"))
    block = cut.groupBy("name", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.concat("label", F.expr(f"substring(row, at + 1, {width})")).alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    out = block.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "\n\n").alias("t"))
    return out.select((F.concat(F.lit("CLUSTAL\n\n"), "t") if form == "clustal" else F.col("t")).alias("value"))


def _scaled(x: Column) -> Column:
    return iround(x * F.lit(SCALE)).cast("long").cast("string")


def _log2_scaled(p: Column) -> Column:
    return F.when(p > 0, (-iround(F.log2(p) * F.lit(SCALE))).cast("long").cast("string")).otherwise("*")


def _rows(cells: DataFrame, keys: list[str], pos: str, text: Column) -> DataFrame:
    """keys, pos, t: the values of a column of a profile, tab-separated in order of letters."""
    return cells.select(*keys, pos, "a", text.alias("_t")).groupBy(*keys, pos).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "_t"))), lambda x: x["_t"]), "\t").alias("t"))


def _body(rows: DataFrame, keys: list[str], pos: str, line: Column) -> DataFrame:
    return rows.withColumn("_line", line).groupBy(*keys).agg(F.count(F.lit(1)).alias("length"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, "_line"))), lambda x: x["_line"]), "\n").alias("body"))


def profile_text(cells: DataFrame, columns: DataFrame, abc: Alphabet, id_col: str = "id") -> DataFrame:
    """Count profiles: cells (id, i, a, v), columns (id, i, neff)."""
    own = cells.filter(F.col("a") < abc.size).join(columns, [id_col, "i"])
    neff = F.first("neff")
    rows = _rows(own.withColumn("p", F.when(F.col("neff") > 0, F.col("v") / F.col("neff"))), [id_col], "i", _log2_scaled(F.coalesce("p", F.lit(0.0))))
    rows = rows.join(columns, [id_col, "i"])
    body = _body(rows, [id_col], "i", F.concat_ws("\t", (F.col("i") + 1).cast("string"), "t", _scaled(F.col("neff"))))
    head = F.concat(F.lit("CountProfile\nNAME\t"), F.col(id_col).cast("string"), F.lit("\nLENG\t"), F.col("length").cast("string"), F.lit(f"\nALPH\t{abc.size}\nCOUNTS\t" + "\t".join(abc.letters) + "\tNEFF\n"))
    del neff
    return body.select(F.concat(head, "body", F.lit("\n//")).alias("value"))


def library_text(states: DataFrame, cells: DataFrame, abc: Alphabet) -> DataFrame:
    """A context library as one record: states (k, name, prior, colour, is_log), cells (k, j, a, p)."""
    p = F.when(F.col("is_log"), F.exp("p")).otherwise(F.col("p"))
    rows = _rows(cells.join(states.select("k", "is_log"), "k").withColumn("p", p), ["k"], "j", _log2_scaled(F.col("p")))
    body = _body(rows, ["k"], "j", F.concat_ws("\t", (F.col("j") + 1).cast("string"), "t"))
    one = body.join(states, "k").select("k", "length", F.concat(F.lit("ContextProfile\nNAME\t"), "name", F.lit("\nPRIOR\t"), F.format_string("%.8g", "prior"), F.lit("\nCOLOR\t"), "colour", F.lit("\nISLOG\t"), F.when(F.col("is_log"), "T").otherwise("F"), F.lit("\nLENG\t"), F.col("length").cast("string"), F.lit(f"\nALPH\t{abc.size}\nPROBS\t" + "\t".join(abc.letters) + "\n"), "body", F.lit("\n//")).alias("t"))
    return one.groupBy().agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("w"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n").alias("t")).select(F.concat(F.lit("ContextLibrary\nSIZE\t"), F.col("n").cast("string"), F.lit("\nLENG\t"), F.col("w").cast("string"), F.lit("\n"), "t").alias("value"))


def crf_text(states: DataFrame, weights: DataFrame, emissions: DataFrame, abc: Alphabet) -> DataFrame:
    rows = _rows(weights, ["k"], "j", F.when(F.col("w") == F.lit(float("-inf")), "*").otherwise(_scaled(F.col("w"))))
    body = _body(rows, ["k"], "j", F.concat_ws("\t", (F.col("j") + 1).cast("string"), "t"))
    pc = emissions.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", _scaled(F.col("w")).alias("t")))), lambda x: x["t"]), "\t").alias("pc"))
    one = body.join(states, "k").join(pc, "k").select("k", "length", F.concat(F.lit("CrfState\nNAME\t"), "name", F.lit("\nBIAS\t"), F.format_string("%.8g", "bias"), F.lit("\nLENG\t"), F.col("length").cast("string"), F.lit(f"\nALPH\t{abc.size}\nWEIGHTS\t" + "\t".join(abc.letters) + "\n"), "body", F.lit("\nPC\t"), "pc", F.lit("\n//")).alias("t"))
    return one.groupBy().agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("w"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n").alias("t")).select(F.concat(F.lit("CRF\nSIZE\t"), F.col("n").cast("string"), F.lit("\nLENG\t"), F.col("w").cast("string"), F.lit("\n"), "t").alias("value"))


def training_sequence_text(train: DataFrame, abc: Alphabet) -> DataFrame:
    """Windows (header, seq, y) to predict from, natural logs of y."""
    y = F.array_join(F.transform("y", lambda v: F.when(v > 0, (-iround(F.ln(v) * F.lit(SCALE))).cast("long").cast("string")).otherwise("*")), "\t")
    return train.select(F.concat(F.lit("TrainingSequence\n\t" + "\t".join(abc.letters + abc.any_letter) + "\nPC\t"), y, F.lit("\n>"), "header", F.lit("\n"), wrapped(F.col("seq")), F.lit("\n//")).alias("value"))


def matrix_text(cells: DataFrame, seqs: DataFrame, abc: Alphabet, id_col: str = "id") -> DataFrame:
    """Rounded log-odds matrices: cells (id, i, a, v), seqs (id, seq)."""
    rows = _rows(cells, [id_col], "i", iround(F.col("v")).cast("long").cast("string")).join(seqs, id_col)
    body = _body(rows, [id_col], "i", F.concat((F.col("i") + 1).cast("string"), F.lit(" "), F.expr("substring(seq, i + 1, 1)"), F.lit("\t"), "t"))
    return body.select(F.concat(F.lit("Last\n\t" + "\t".join(abc.letters) + "\n"), "body").alias("value"))


def checkpoint_bytes(profiles: DataFrame, abc: Alphabet) -> DataFrame:
    """id, content: binary matrices of (id, seq, profile), as `read_checkpoints` reads them."""

    def pack(it):
        for pdf in it:
            pdf["content"] = [struct.pack("<i", len(s)) + s.encode("ascii") + b"".join(struct.pack(f"<{abc.size}d", *r) for r in p) for s, p in zip(pdf["seq"], pdf["profile"], strict=True)]
            yield pdf[["id", "content"]]

    return profiles.select("id", "seq", "profile").mapInPandas(pack, f"id {profiles.schema['id'].dataType.simpleString()}, content binary")


def write_files(rows: DataFrame, directory: str, name: str = "id", content: str = "content") -> None:
    """Each row as a file of its own, through the Hadoop file system of the path."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(directory).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in rows.select(name, content).toLocalIterator():  # a few small model files
        out = fs.create(path(f"{directory}/{r[0]}"), True)
        out.write(bytearray(r[1]))
        out.close()


def running_id(df: DataFrame, order: list[str]) -> DataFrame:
    return df.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)
