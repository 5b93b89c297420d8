"""Readers of sequence, alignment, profile, model and hit files as DataFrames.

Text files are read by Spark in whole records (a separator of the format), so a file may be split
between tasks; only formats whose records span a whole file (alignments, reports, checkpoints) are
one row a file. A malformed record raises.
"""

from __future__ import annotations

import re
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabets import AA, Alphabet, checked, cleaned

SCALE = 1000.0
FORMATS = {"fas": "fasta", "mfa": "fasta", "a2m": "a2m", "a3m": "a3m", "clu": "clustal", "psi": "psi"}


def files(spark: SparkSession, directory: str, extension: str) -> DataFrame:
    """path, name: the files of a directory with an extension."""
    out = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(directory).select("path")
    return out.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))


def rounds(names: Column) -> tuple[Column, Column]:
    """(id, round) of names like id_3.prf; round 0 where there is none."""
    return F.regexp_extract(names, r"^(.*?)(?:_(\d+))?\.[^.]*$", 1), F.coalesce(F.expr("null").cast("int"), F.when(F.regexp_extract(names, r"_(\d+)\.[^.]*$", 1) != "", F.regexp_extract(names, r"_(\d+)\.[^.]*$", 1)).otherwise("0").cast("int"))


def round_sets(names: DataFrame, name: str = "name") -> DataFrame:
    """id, rounds (a bit for each round), last: files of one id grouped."""
    i, r = rounds(F.col(name))
    return names.select(i.alias("id"), r.alias("r")).groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, r)")).alias("rounds"), F.max("r").alias("last"))


def has_round(mask: Column, r: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << r)) != 0


def record_class(path_df: DataFrame) -> DataFrame:
    """path, class: the class tag in the first line of each file."""
    return path_df.select("path", F.regexp_extract("value", r"^(\w+)", 1).alias("class"))


def read_fasta(spark: SparkSession, path: str, abc: Alphabet | None = None, limit: int | None = None) -> DataFrame:
    """header, seq: records of a FASTA file; gaps and white space are taken out, other characters are checked."""
    raw = spark.read.option("lineSep", "\n>").text(path).filter(F.trim("value") != "")
    body = F.regexp_replace("value", r"^>", "")
    out = raw.select(F.substring_index(body, "\n", 1).alias("header"), cleaned(F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"(?s)\n//.*$|^//.*$", "")).alias("seq"))
    if abc is not None:
        out = out.withColumn("seq", checked(F.col("seq"), abc))
    return out if limit is None else out.limit(limit)


ALIGNMENT = "name string, k int, header string, row string"


def read_alignments(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """path, name, k, header, row: rows of alignment files; the format follows the extension unless given.

    Annotation records (ss_, sa_) in front of the first kept one are dropped. Rows of a3m are padded, so
    that all rows of a file have one length; in a2m and a3m lower case and dots are insert columns.
    """

    def parse(it):
        import pandas as pd

        for pdf in it:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                f = form or FORMATS.get(p.rsplit(".", 1)[-1], "fasta")
                name, found = parse_alignment(content.decode(), f)
                rows += [(p, name, k, h, s) for k, (h, s) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "name", "k", "header", "row"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, " + ALIGNMENT)


def parse_alignment(text: str, form: str) -> tuple[str, list[tuple[str, str]]]:
    """(name, [(header, row)]) of one alignment file."""
    if form == "clustal":
        raise ValueError("this format is only written")
    if form == "psi":
        return "", _parse_psi(text)
    name, rows, keep = "", [], False
    for line in text.splitlines():
        if line.startswith("#") and not rows:
            name = line[1:].strip()
        elif line.startswith(">"):
            keep = bool(rows) or not line.startswith((">ss_", ">sa_"))
            if keep:
                rows.append([line[1:], []])
        elif keep:
            rows[-1][1].append(re.sub(r"\s", "", line))
    found = [(h, "".join(parts)) for h, parts in rows]
    if form == "fasta":
        found = [(h, s.upper().replace(".", "-")) for h, s in found]
    elif form == "a3m":
        found = _padded(found)
    if len({len(s) for _, s in found}) > 1:
        raise ValueError("rows of an alignment differ in length")
    return name, found


def _parse_psi(text: str) -> list[tuple[str, str]]:
    blocks, block = [], []
    for line in [*text.splitlines(), ""]:
        if line.strip():
            block.append(line.split())
        elif block:
            blocks.append(block)
            block = []
    if len({len(b) for b in blocks}) > 1:
        raise ValueError("blocks differ in their number of rows")
    return [(blocks[0][k][0], "".join(b[k][-1] for b in blocks)) for k in range(len(blocks[0]))] if blocks else []


def _padded(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """a3m rows with inserts filled up to the widest one between two match columns."""
    parts = []
    for _, s in rows:
        if "." in s:
            raise ValueError("a3m rows have no dots")
        parts.append(re.findall(r"^[a-z]*|[A-Z-][a-z]*", s))
    if len({len(p) for p in parts}) > 1:
        raise ValueError("rows differ in their number of match columns")
    wide = [max(map(len, column)) for column in zip(*parts, strict=True)]
    return [(h, "".join(x.ljust(w, ".") for x, w in zip(p, wide, strict=True))) for (h, _), p in zip(rows, parts, strict=True)]


def alignment_cells(rows: DataFrame, abc: Alphabet, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """keys, k, i, chr, a, is_match: one row for each cell; the last row's case says which columns match."""
    from pyspark.sql import Window

    from ..functions.alphabets import encoded, is_match_char

    last = F.max_by("row", "k").over(Window.partitionBy(*keys))
    c = rows.select(*keys, "k", F.posexplode(F.split("row", "")).alias("i", "chr"), last.alias("_last")).filter("chr != ''")
    return c.withColumns({"a": encoded(F.col("chr"), abc), "is_match": is_match_char(F.expr("substring(_last, i + 1, 1)"))}).drop("_last")


def _blocks(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """rec, lines: records that end with // and hold the tag; everything in front of the tag is a file's head."""
    raw = spark.read.option("lineSep", "\n//").text(path).select(F.monotonically_increasing_id().alias("rec"), "value").filter(F.col("value").contains(tag + "\n"))
    return raw.select("rec", F.split(F.regexp_replace("value", rf"(?s)^.*?(?:^|\n){tag}\n", ""), "\n").alias("lines"))


def _field(name: str) -> Column:
    return F.regexp_extract(F.element_at(F.filter("lines", lambda x: x.startswith(name + "\t") | x.startswith(name + " ")), 1), rf"^{name}\s+(.*?)\s*$", 1)


def _numbered(name: str = "lines") -> Column:
    """Rows of numbers behind a position, as (i from 0, [values as text])."""
    rows = F.filter(name, lambda x: x.rlike(r"^\d+\s"))
    return F.transform(rows, lambda x: F.struct((F.split(x, r"\s+")[0].cast("int") - 1).alias("i"), F.filter(F.slice(F.split(F.trim(x), r"\s+"), 2, 10_000), lambda y: y != "").alias("v")))


def _power(v: Column) -> Column:
    """2 ** (-v / 1000), 0 for the sign of zero."""
    return F.when(v == "*", F.lit(0.0)).otherwise(F.pow(F.lit(2.0), -v.cast("double") / F.lit(SCALE)))


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells: rec, name, i, a, v; columns: rec, name, i, neff) of count profiles; v are counts."""
    b = _blocks(spark, path, "CountProfile").select("rec", _field("NAME").alias("name"), _field("ALPH").cast("int").alias("size"), F.explode(_numbered()).alias("r"))
    cols = b.select("rec", "name", "size", "r.i", "r.v", (F.element_at("r.v", -1).cast("double") / F.lit(SCALE)).alias("neff"))
    cells = cols.select("rec", "name", "i", "neff", F.posexplode(F.slice("v", F.lit(1), F.col("size"))).alias("a", "t")).withColumn("p", _power(F.col("t")))
    from pyspark.sql import Window

    total = F.sum("p").over(Window.partitionBy("rec", "i"))
    return cells.select("rec", "name", "i", "a", F.when(total > 0, F.col("p") * F.col("neff") / total).otherwise(F.lit(0.0)).alias("v")), cols.select("rec", "name", "i", "neff")


def read_library(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(states: k, name, prior, colour, is_log; cells: k, j, a, p) of a context library, states in file order."""
    from pyspark.sql import Window

    b = _blocks(spark, path, "ContextProfile").withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rec")) - 1)  # a model: thousands of states at most
    states = b.select("k", _field("NAME").alias("name"), _field("PRIOR").cast("double").alias("prior"), _field("COLOR").alias("colour"), _field("ISLOG").isin("T", "1").alias("is_log"))
    cells = b.select("k", F.explode(_numbered()).alias("r")).select("k", F.col("r.i").alias("j"), F.posexplode("r.v").alias("a", "t"))
    return states, cells.select("k", "j", "a", _power(F.col("t")).alias("p"))


def read_crf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(states: k, name, bias; weights: k, j, a, w; emissions: k, a, w) of a conditional model."""
    from pyspark.sql import Window

    b = _blocks(spark, path, "CrfState").withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rec")) - 1)
    number = lambda t: F.when(t == "*", F.lit(float("-inf"))).otherwise(t.cast("double") / F.lit(SCALE))
    weights = b.select("k", F.explode(_numbered()).alias("r")).select("k", F.col("r.i").alias("j"), F.posexplode("r.v").alias("a", "t")).select("k", "j", "a", number(F.col("t")).alias("w"))
    pc = b.select("k", F.posexplode(F.filter(F.split(_field("PC"), r"\s+"), lambda x: x != "")).alias("a", "t")).select("k", "a", number(F.col("t")).alias("w"))
    return b.select("k", _field("NAME").alias("name"), _field("BIAS").cast("double").alias("bias")), weights, pc


def read_training_sequences(spark: SparkSession, path: str) -> DataFrame:
    """rec, header, seq, y: windows with the distribution to predict."""
    b = _blocks(spark, path, "TrainingSequence")
    y = F.transform(F.filter(F.split(_field("PC"), r"\s+"), lambda x: x != ""), lambda t: F.when(t == "*", F.lit(0.0)).otherwise(F.exp(-t.cast("double") / F.lit(SCALE))))
    head = F.element_at(F.filter("lines", lambda x: x.startswith(">")), 1)
    at = F.array_position("lines", head)
    seq = cleaned(F.array_join(F.filter("lines", lambda x, i: i >= at), ""))
    return b.select("rec", F.substring(head, 2, 1 << 30).alias("header"), seq.alias("seq"), y.alias("y"))


def read_training_profiles(spark: SparkSession, path: str) -> DataFrame:
    """rec, x (rows of counts), neff, y: profile windows with the distribution to predict."""
    b = _blocks(spark, path, "TrainingProfile")
    y = F.transform(F.filter(F.split(_field("PC"), r"\s+"), lambda x: x != ""), lambda t: F.when(t == "*", F.lit(0.0)).otherwise(F.exp(-t.cast("double") / F.lit(SCALE))))
    rows = _numbered()
    x = F.transform(rows, lambda r: F.transform(F.slice(r["v"], F.lit(1), F.size(r["v"]) - 1), lambda t: F.when(t == "*", F.lit(0.0)).otherwise(F.pow(F.lit(2.0), -t.cast("double") / F.lit(SCALE)) * F.element_at(r["v"], -1).cast("double") / F.lit(SCALE))))
    return b.select("rec", x.alias("x"), F.transform(rows, lambda r: F.element_at(r["v"], -1).cast("double") / F.lit(SCALE)).alias("neff"), y.alias("y"))


def read_checkpoints(spark: SparkSession, path: str, abc: Alphabet = AA) -> DataFrame:
    """path, seq, profile: binary matrices (int32 length, letters, then length * size doubles, little-endian)."""

    def parse(it):
        import pandas as pd

        for pdf in it:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                (n,) = struct.unpack_from("<i", raw)
                v = struct.unpack_from(f"<{n * abc.size}d", raw, 4 + n)
                rows.append((p, raw[4 : 4 + n].decode("ascii"), [list(v[i * abc.size : (i + 1) * abc.size]) for i in range(n)]))
            yield pd.DataFrame(rows, columns=["path", "seq", "profile"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, seq string, profile array<array<double>>")


HITS = "oid int, definition string, bit_score double, evalue double, hsps array<struct<bit_score:double,evalue:double,q_start:int,q_end:int,s_start:int,s_end:int,q_seq:string,s_seq:string,length:int>>"


def parse_hits(text: str) -> tuple[int | None, list[dict]]:
    """(query length, hits) of a pairwise search report: the list of hits, then blocks of aligned pairs."""
    lines, at, query, hits = text.splitlines(), 0, None, []
    while at < len(lines) and "Sequences producing significant alignments" not in lines[at]:
        if m := re.search(r"(\d+)[^\d]*letters\)", lines[at]):
            query = int(m[1])
        at += 1
    at += 2
    while at < len(lines) and lines[at].strip():
        m = re.match(r"^(.*\S)\s+(\S+)\s+(\S*\d)\s*$", lines[at])
        if not m:
            break
        e = m[3] if m[3][0] != "e" else "1" + m[3]
        hits.append({"oid": len(hits) + 1, "definition": m[1], "bit_score": float(m[2]), "evalue": float(e), "hsps": []})
        at += 1
    i = -1
    for line in lines[at:]:
        if "Database:" in line:
            break
        if line.startswith(">"):
            i += 1
            if i >= len(hits):
                break
        elif m := re.search(r"Score =\s*(\S+).*?=\s*([^\s,]+)", line):
            e = m[2] if m[2][0] != "e" else "1" + m[2]
            hits[i]["hsps"].append({"bit_score": float(m[1]), "evalue": float(e), "q_start": 0, "q_end": 0, "s_start": 0, "s_end": 0, "q_seq": "", "s_seq": "", "length": 0})
        elif m := re.match(r"(Query|Sbjct):\s*(\d+)\s*(\S+)\s*(\d+)", line):
            h, q = hits[i]["hsps"][-1], "q" if m[1] == "Query" else "s"
            h[f"{q}_start"] = h[f"{q}_start"] or int(m[2])
            h[f"{q}_seq"] += m[3]
            h[f"{q}_end"] = int(m[4])
            h["length"] = len(h["q_seq"])
    return query, hits


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """path, query_length and the hits of search reports with their aligned pairs nested."""

    def parse(it):
        import pandas as pd

        for pdf in it:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                query, hits = parse_hits(raw.decode())
                rows += [(p, query, h["oid"], h["definition"], h["bit_score"], h["evalue"], h["hsps"]) for h in hits]
            yield pd.DataFrame(rows, columns=["path", "query_length", "oid", "definition", "bit_score", "evalue", "hsps"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, query_length int, " + HITS)


def read_state_matrix(spark: SparkSession, path: str) -> DataFrame:
    """k, s, q: rows of numbers behind a line that names the states."""

    def parse(it):
        import pandas as pd

        for pdf in it:
            rows = []
            for raw in pdf["content"]:
                for k, line in enumerate(x for x in raw.decode().splitlines()[1:] if x.strip()):
                    rows += [(k, s, float(v)) for s, v in enumerate(line.split())]
            yield pd.DataFrame(rows, columns=["k", "s", "q"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "k int, s int, q double")


def read_labelled_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, class, fold, superfamily, family and the sizes of these levels, from headers `id a.1.2.3 ...`."""
    from pyspark.sql import Window

    label = F.split(F.regexp_extract("header", r"^\S+\s+(\S+)", 1), r"\.")
    out = read_fasta(spark, path).select(F.regexp_extract("header", r"^(\S+)", 1).alias("id"), *[F.array_join(F.slice(label, 1, n), ".").alias(c) for n, c in enumerate(("class", "fold", "superfamily", "family"), 1)])
    return out.withColumns({f"n_{c}": F.count(F.lit(1)).over(Window.partitionBy(c)) for c in ("class", "fold", "superfamily", "family")})


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """query, target, i, j, confidence: blocks of aligned pairs, each behind a line with its two names."""

    def parse(it):
        import pandas as pd

        for pdf in it:
            rows, q, t = [], "", ""
            for raw in pdf["content"]:
                for line in raw.decode().splitlines():
                    part = line.split("\t")
                    if len(part) == 2:
                        q, t = part
                    elif len(part) >= 3:
                        rows.append((q, t, int(part[0]), int(part[1]), float(part[2])))
            yield pd.DataFrame(rows, columns=["query", "target", "i", "j", "confidence"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "query string, target string, i int, j int, confidence double")
