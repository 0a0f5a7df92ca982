import pytest
from pyspark.sql import functions as F

from lociweave import cli
from lociweave.sources import fasta, writers

TEXT = "> GeneA chr1 + 100 150 160 300\n> GeneB\tchr2 -  x 250 260 400\n>one\r\nTACG\nTCA\n>two\nGACGTTC\n"


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(TEXT)
    (tmp_path / "b.fasta").write_text("")
    lines = fasta.file_lines(spark, str(tmp_path))
    assert sorted(r.n_headers for r in fasta.header_count(lines).collect()) in ([0, 2], [2])
    sequences, genes = fasta.read_families(spark, str(tmp_path))
    assert [(r.seq_idx, r.name, r.bases, r.len) for r in sequences.orderBy("seq_idx").collect()] == [(0, "one", "TACGTCA", 7), (1, "two", "GACGTTC", 7)]
    got = [tuple(r)[2:] for r in genes.orderBy("seq_idx").collect()]
    assert got == [("GeneA", "chr1", "+", 100, 150, 160, 300), ("GeneB", "chr2", "-", 0, 250, 260, 400)]


def test_lists_and_tables(spark, tmp_path):
    (tmp_path / "k.txt").write_text("8 12\n\n16\tx\n")
    assert sorted(r.k for r in fasta.read_k_list(spark, str(tmp_path / "k.txt")).collect()) == [8, 12, 16]
    (tmp_path / "a.tsv").write_text("id\tlen\tx\ty\tz\n1\t5\t10\t20\t30\n")
    assert [(r.row_id, r.len, list(r.pos)) for r in fasta.read_anchor_table(spark, str(tmp_path / "a.tsv")).collect()] == [(1, 5, [10, 20, 30])]


def lines_of(path):
    return [x for f in sorted(path.rglob("part-*")) for x in f.read_text().splitlines()]


@pytest.mark.parametrize("mode, pos, starts", [("literal", "2,3", "102,103"), ("strict", "2,2", "101,101")])
def test_command_line_writes_all_tables(spark, tmp_path, mode, pos, starts):
    """The first hand-derived case: all tables, line by line."""
    (tmp_path / "in.fasta").write_text("> Aa1 chr1 + 100 150 160 300\n> Bb1 chr2 + 100 150 160 300\n>Aa1\nTACGTCA\n>Bb1\nGACGTTC\n")
    cli.main(["-mem", "3", "-file", str(tmp_path / "in.fasta"), "-out", str(tmp_path / "out"), "-mode", mode, "-by_name"])
    table = lambda name: lines_of(tmp_path / f"out_{name}")
    assert table("MEM_1_3") == ["MEM,Length,S_1,S_2", "0,0,0,0", f"1,4,{pos}", "0,7,7,7"]
    assert table("MEM_2_3") == table("LPMEM_3") == ["Length,S_1,S_2", "0,0,0", f"4,{pos}", "7,7,7"]
    assert table("CNS_3") == ["Aa1", "Bb1", "LEN,Aa,Bb,Chr_Aa,Chr_Bb,CNS", f"4,{starts},chr1,chr2,ACGT"]
    assert table("mems_3") == ["ACGT"]
    a, b = map(int, starts.split(","))
    assert table("tracks_3") == ["kind,seq_idx,start,stop", f"track,0,{a},{a + 3}", "gene,0,150,160", f"track,1,{b},{b + 3}", "gene,1,150,160"]
    assert "Aa1" in " ".join(table("MEM_3_pages"))


def test_tables_keep_the_order_of_a_chain(spark):
    chain = spark.createDataFrame([(1, 1, 9, 5, [8, 9]), (1, 2, 2, 4, [1, 2])], "family_id long, step int, row_id long, len int, pos array<int>")
    lengths = spark.createDataFrame([(1, 30), (1, 40)], "family_id long, len long")
    got = writers.anchor_lines(chain, lengths, serial=False, order_by="step").orderBy("place").collect()
    assert [r.line for r in got] == ["Length,S_1,S_2", "0,0,0", "5,8,9", "4,1,2", "40,40,40"]


def test_paths_and_brush(spark, tmp_path):
    chains = spark.createDataFrame([(1, [3, 5])], "family_id long, path array<long>")
    writers.write_paths(chains, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).select("value").first().value == "3-5"
    rows = spark.createDataFrame([(1, [3, 50]), (2, [9, 50])], "row_id long, pos array<int>")
    assert [r.row_id for r in writers.brushed(rows, {0: (1, 5), 1: (50, 60)}).select(F.col("row_id")).collect()] == [1]
