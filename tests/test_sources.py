"""Readers and writers round trip on fixtures made here."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.functions.alphabets import AA, DNA
from strandline.sources import records, writers


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "x.fas", ">one first\nAC-G\nT T\n>two\nGG.\n")
    got = [(r.header, r.seq) for r in records.read_fasta(spark, p, DNA).collect()]
    assert got == [("one first", "ACGTT"), ("two", "GG")]
    text = [r.value for r in writers.fasta_text(spark.createDataFrame([("h", "A" * 150)], "header string, seq string")).collect()]
    assert text == [">h\n" + "A" * 100 + "\n" + "A" * 50]


def test_a3m_is_padded_and_annotations_go(spark, tmp_path):
    p = put(tmp_path / "x.a3m", "#name\n>ss_pred\nHHH\n>q\nACG\n>s\nA-aaG\n>t\nAcCG\n")
    rows = {r.k: (r.header, r.row) for r in records.read_alignments(spark, p).collect()}
    assert rows == {0: ("q", "A.C..G"), 1: ("s", "A.-aaG"), 2: ("t", "AcC..G")}
    back = writers.alignment_text(records.read_alignments(spark, p), "a3m").first().value
    assert back == "#name\n>q\nACG\n>s\nA-aaG\n>t\nAcCG"


def test_a3m_errors():
    with pytest.raises(ValueError, match="dots"):
        records.parse_alignment(">a\nA.C\n", "a3m")
    with pytest.raises(ValueError, match="match columns"):
        records.parse_alignment(">a\nAC\n>b\nA\n", "a3m")
    with pytest.raises(ValueError, match="only written"):
        records.parse_alignment("", "clustal")


def test_psi_blocks(spark, tmp_path):
    rows = spark.createDataFrame([("n", 0, "one x", "A" * 70), ("n", 1, "two", "C" * 69 + "-")], "name string, k int, header string, row string")
    text = writers.alignment_text(rows, "psi").first().value
    assert text.count("\n\n") == 1
    assert records.parse_alignment(text, "psi")[1] == [("one", "A" * 70), ("two", "C" * 69 + "-")]
    with pytest.raises(ValueError, match="number of rows"):
        records.parse_alignment("a AC\nb AC\n\na AC\n", "psi")


def test_match_state_comes_from_the_last_row(spark):
    rows = spark.createDataFrame([("p", 0, "AC"), ("p", 1, "A.")], "path string, k int, row string")
    got = {(r.k, r.i): r.is_match for r in records.alignment_cells(rows, DNA).collect()}
    assert got == {(0, 0): True, (0, 1): False, (1, 0): True, (1, 1): False}


def test_profiles_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("p", 0, a, v) for a, v in enumerate((1.0, 1.0, 0.0, 0.0))] + [("p", 1, a, 0.5) for a in range(4)], "id string, i int, a int, v double")
    cols = spark.createDataFrame([("p", 0, 2.0), ("p", 1, 2.0)], "id string, i int, neff double")
    text = writers.profile_text(cells, cols, DNA)
    assert text.first().value.splitlines()[:6] == ["CountProfile", "NAME\tp", "LENG\t2", "ALPH\t4", "COUNTS\tA\tC\tG\tT\tNEFF", "1\t1000\t1000\t*\t*\t2000"]
    writers.write_text(text, str(tmp_path / "out"))
    c, n = records.read_profiles(spark, str(tmp_path / "out"))
    assert {(r.i, r.a): round(r.v, 6) for r in c.collect()} == {(r.i, r.a): r.v for r in cells.collect()}
    assert {r.i: r.neff for r in n.collect()} == {0: 2.0, 1: 2.0}
    writers.write_text(text, str(tmp_path / "out"), "append")
    assert records.read_profiles(spark, str(tmp_path / "out"))[1].count() == 4


def test_library_and_crf_round_trip(spark, tmp_path):
    states = spark.createDataFrame([(0, "A1", 0.25, "0.10,0.20,0.30", False), (1, "B1", 0.75, "1.00,1.00,1.00", False)], "k int, name string, prior double, colour string, is_log boolean")
    cells = spark.createDataFrame([(k, j, a, 0.25) for k in range(2) for j in range(3) for a in range(4)], "k int, j int, a int, p double")
    writers.write_text(writers.library_text(states, cells, DNA), str(tmp_path / "lib"))
    s, c = records.read_library(spark, str(tmp_path / "lib"))
    assert [(r.k, r.name, r.prior, r.colour) for r in s.orderBy("k").collect()] == [(0, "A1", 0.25, "0.10,0.20,0.30"), (1, "B1", 0.75, "1.00,1.00,1.00")]
    assert c.count() == 24 and c.filter("p = 0.25").count() == 24
    bias = spark.createDataFrame([(0, "s", -1.5)], "k int, name string, bias double")
    cw = spark.createDataFrame([(0, j, a, 0.001 * (j - a)) for j in range(3) for a in range(4)], "k int, j int, a int, w double")
    pc = spark.createDataFrame([(0, a, -0.5 * a) for a in range(4)], "k int, a int, w double")
    writers.write_text(writers.crf_text(bias, cw, pc, DNA), str(tmp_path / "crf"))
    b, w, e = records.read_crf(spark, str(tmp_path / "crf"))
    assert b.first().bias == -1.5
    assert {(r.j, r.a): round(r.w, 6) for r in w.collect()} == {(r.j, r.a): round(r.w, 6) for r in cw.collect()}
    assert {r.a: r.w for r in e.collect()} == {a: -0.5 * a for a in range(4)}


def test_training_sequences(spark, tmp_path):
    t = spark.createDataFrame([("w1", "ACG", [1.0, 0.0, 0.0, 0.0, 0.0])], "header string, seq string, y array<double>")
    writers.write_text(writers.training_sequence_text(t, DNA), str(tmp_path / "t"))
    r = records.read_training_sequences(spark, str(tmp_path / "t")).first()
    assert (r.header, r.seq, r.y) == ("w1", "ACG", [1.0, 0.0, 0.0, 0.0, 0.0])


def test_checkpoints(spark, tmp_path):
    rows = spark.createDataFrame([("a.chk", "AR", [[0.05] * 20, [0.1] + [0.9 / 19] * 19])], "id string, seq string, profile array<array<double>>")
    writers.write_files(writers.checkpoint_bytes(rows, AA), str(tmp_path))
    r = records.read_checkpoints(spark, str(tmp_path / "a.chk")).first()
    assert r.seq == "AR" and r.profile[1][0] == 0.1 and len(r.profile[0]) == 20


REPORT = """Query= q
         (12 letters)

Sequences producing significant alignments:                      (bits) Value

first hit of two                                                  40.1   e-10
second hit                                                        20.5   0.5

>first hit of two
 Score = 40.1 bits (93),  Expect = e-10, Method: x
Query: 3  ACDE-F 7
          AC E  F
Sbjct: 10 ACEEGF 15

Query: 8  GH 9
Sbjct: 16 GH 17

>second hit
 Score = 20.5 bits (40),  Expect = 0.5
Query: 1 AC 2
Sbjct: 1 AC 2
  Database: x
"""


def test_hit_reports(spark, tmp_path):
    p = put(tmp_path / "r.txt", REPORT)
    rows = records.read_hits(spark, p).orderBy("oid").collect()
    assert [(r.query_length, r.definition, r.bit_score, r.evalue, len(r.hsps)) for r in rows] == [(12, "first hit of two", 40.1, 1e-10, 1), (12, "second hit", 20.5, 0.5, 1)]
    h = rows[0].hsps[0]
    assert (h.q_start, h.q_end, h.s_start, h.s_end, h.q_seq, h.s_seq, h.length) == (3, 9, 10, 17, "ACDE-FGH", "ACEEGFGH", 8)


def test_labels_rounds_and_matrices(spark, tmp_path):
    p = put(tmp_path / "l.fas", ">d1 a.1.1.1 x\nAC\n>d2 a.1.2.1\nAC\n")
    rows = {r.id: (r.fold, r.superfamily, r.n_fold, r.n_superfamily) for r in records.read_labelled_fasta(spark, p).collect()}
    assert rows == {"d1": ("a.1", "a.1.1", 2, 1), "d2": ("a.1", "a.1.2", 2, 1)}
    n = spark.createDataFrame([("x_0.prf",), ("x_3.prf",), ("y.prf",)], "name string")
    assert {r.id: (r.rounds, r["last"]) for r in records.round_sets(n).collect()} == {"x": (9, 3), "y": (1, 0)}
    assert {(r.k, r.s): r.q for r in records.read_state_matrix(spark, put(tmp_path / "m.mat", "a b\n0.5 0.25\n0.25 0\n")).collect()} == {(0, 0): 0.5, (0, 1): 0.25, (1, 0): 0.25, (1, 1): 0.0}
    assert [(r.query, r.target, r.i, r.j) for r in records.read_pairs(spark, put(tmp_path / "p.tab", "a\tb\n1\t2\t0.9\n")).collect()] == [("a", "b", 1, 2)]
    assert [r.name for r in records.files(spark, str(tmp_path), "mat").collect()] == ["m.mat"]
    assert n.filter(records.has_round(F.lit(9), 3)).count() == 3
