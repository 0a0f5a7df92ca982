"""Files in byte ranges, offsets, positions by last start, walks of the order graph, observations and several K."""

import random

import pytest
from pyspark.sql import functions as F

from lociweave import cli
from lociweave.operators import chain as C
from lociweave.operators import coordinates as X
from lociweave.plans import discover as P
from lociweave.sources import fasta

FILE = "no header yet\n> GeneA chr1 + 100 150 160 300\n> GeneB\tchr2 -  x 250 260 400\n>one\r\nTACG\nTCA\n> late chr3 + 1 2 3 4\nGGG\n>two\nGACGTTC\n>\nAC\n>empty\n"


def plain(text):
    """Sequences and metadata lines of a file, line by line."""
    names, bases, genes = [], [], []
    for line in text.replace("\r", "").split("\n"):
        if line.startswith((">\t", "> ")):
            genes.append(line)
        elif line.startswith(">"):
            names.append(line[1:])
            bases.append("")
        elif names:
            bases[-1] += line
    return list(zip(names, bases, strict=True)), genes


@pytest.mark.parametrize("split", ["128m", "7", "64"])
def test_files_are_read_in_byte_ranges(spark, tmp_path, split):
    rnd = random.Random(4)
    long = "".join(f">s{k} x\n" + "\n".join("".join(rnd.choice("ACGT") for _ in range(rnd.randrange(1, 30))) for _ in range(rnd.randrange(4))) + f"\n> g{k} c + {k} 1 2 3\n" for k in range(60))
    texts = {"a.fasta": FILE, "b.fasta": "", "c.fasta": long, "d.fasta": ">x\nAC", "e.fasta": "only text\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = fasta.file_records(spark, str(tmp_path))
        ranges = records.where("file like '%c.fasta'").select("place.block").distinct().count()
        assert split == "128m" or ranges > 20
        got: dict = {}
        for r in fasta.record_sequences(records).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.seq_idx, r.name, r.bases, r.len))
        genes: dict = {}
        for r in fasta.record_genes(records).collect():
            genes.setdefault(r.file.rsplit("/", 1)[1], []).append((r.seq_idx, r.gene, r.region_start))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in texts.items():
        want, lines = plain(text)
        assert sorted(got.get(name, [])) == [(k, n, b, len(b)) for k, (n, b) in enumerate(want)]
        assert [(k, g) for k, g, _ in sorted(genes.get(name, []))] == [(k, line[1:].split()[0]) for k, line in enumerate(lines)]
    assert sorted(genes["a.fasta"]) == [(0, "GeneA", 100), (1, "GeneB", 0), (2, "late", 1)]


def test_offsets_are_written(spark, tmp_path):
    (tmp_path / "in.fasta").write_text("> Aa1 chr1 + 100 150 160 300\n> Bb1 chr2 + 100 150 160 300\n>Aa1\nTACGTCA\n>Bb1\nGACGTTC\n")
    cli.main(["-mem", "3,4", "-file", str(tmp_path / "in.fasta"), "-out", str(tmp_path / "out"), "-offsets"])
    lines = lambda name: [x for f in sorted((tmp_path / name).rglob("part-*")) for x in f.read_text().splitlines()]
    assert lines("out_offsets") == ["seq_idx,name,start,room", "0,Aa1,0,8", "1,Bb1,8,8"]
    # One search serves both K.
    assert lines("out_mems_3") == lines("out_mems_4") == ["ACGT"]
    (tmp_path / "k.txt").write_text("12 8\n8\n")
    assert fasta.k_values(spark, str(tmp_path / "k.txt")) == [8, 12] and fasta.k_values(spark, "5") == [5]


def test_positions_take_the_last_start_before_them(spark):
    rnd = random.Random(1)
    starts, asked, want = [], [], set()
    for f in range(12):
        at = 0
        for s in range(rnd.choice([1, 3, 60])):
            room = rnd.randrange(0, 9)
            starts.append((f, s, at, room))
            for x in range(at + 1, at + room + 1):
                asked.append((f, x, f"n{x}"))
                want.add((f, x, f"n{x}", s, at))
            at += room
        asked += [(f, at + 1, "beyond"), (f, 0, "before")]
    asked += [(99, 3, "no family")] + asked[:1]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        found = X.local_positions(spark.createDataFrame(asked, "family_id long, at long, name string"), spark.createDataFrame(starts, "family_id long, seq_idx int, start long, room long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r.family_id, r.at, r.name, r.seq_idx, r.start) for r in found} == want and len(found) == len(want) + 1


def walks(rows, use_length):
    """All chains that nothing extends, by a plain search."""
    out = set()
    for f in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == f}
        before = lambda a, b: all(x + (a[2] if use_length else 0) < y for x, y in zip(a[3], b[3], strict=True))
        after = {i: [j for j in own if before(own[i], own[j])] for i in own}
        direct = {i: [j for j in js if not any(j in after[m] for m in js)] for i, js in after.items()}
        todo = [[i] for i in own if not any(i in js for js in after.values())]
        while todo:
            path = todo.pop()
            if not direct[path[-1]]:
                out.add((f, tuple(path), sum(own[i][2] for i in path)))
            todo += [[*path, j] for j in direct[path[-1]]]
    return out


@pytest.mark.parametrize("use_length", [True, False])
def test_walks_and_their_counts(spark, use_length):
    rnd = random.Random(8)
    rows = [(f, k, rnd.randrange(1, 5), [rnd.randrange(30), rnd.randrange(30)]) for f, n in enumerate((14, 1, 6, 22)) for k in range(n)]
    frame = spark.createDataFrame(rows, "family_id long, row_id long, len long, pos array<long>")
    want = walks(rows, use_length)
    got = [(r.family_id, tuple(r.path), r.weight) for r in C.all_chains(frame, use_length).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {r.family_id: (int(r.n_chains), r.longest) for r in C.chain_counts(frame, use_length).collect()}
    assert counts == {f: (sum(w[0] == f for w in want), max(len(w[1]) for w in want if w[0] == f)) for f in range(4)}
    assert C.all_chains(frame.limit(0)).collect() == []


@pytest.mark.parametrize("use_length", [True, False])
def test_small_families_are_walked_without_tables(spark, use_length, monkeypatch):
    """Small families by arrays, larger ones by rounds, give the plain chains; without large ones no graph is written."""
    rnd = random.Random(3)
    rows = [(f, k, rnd.randrange(1, 5), [rnd.randrange(20), rnd.randrange(20)]) for f in range(40) for k in range(rnd.randrange(1, 14))]
    frame = spark.createDataFrame(rows, "family_id long, row_id long, len long, pos array<long>")
    want = walks(rows, use_length)
    most = {f: max(len(w[1]) for w in want if w[0] == f) for f in {w[0] for w in want}}
    both = [(few, C.all_chains(frame, use_length, few=few), C.chain_counts(frame, use_length, few=few), C.all_chains(frame, use_length, few=few, only_longest=True)) for few in (24, 6, 0)]
    for _, chains, counts, longest in both:
        assert sorted((r.family_id, tuple(r.path), r.weight) for r in chains.collect()) == sorted(want)
        assert {r.family_id: (int(r.n_chains), r.longest) for r in counts.collect()} == {f: (sum(w[0] == f for w in want), most[f]) for f in most}
        assert sorted((r.family_id, tuple(r.path), r.weight) for r in longest.collect()) == sorted(w for w in want if len(w[1]) == most[w[0]])
    monkeypatch.setattr(C, "Order", None)
    assert C.all_chains(frame, use_length).count() == len(want) and C.chain_counts(frame, use_length).count() == len(most)


def test_more_chains_than_asked_for_are_an_error_before_any_is_listed(spark):
    """40 layers of 2 anchors each: 2 ** 40 chains are counted, not listed."""
    rows = [(1, 2 * k + s, 1, [10 * k + s, 10 * k + 1 - s]) for k in range(12) for s in (0, 1)]
    frame = spark.createDataFrame(rows, "family_id long, row_id long, len long, pos array<long>")
    assert int(C.chain_counts(frame).first().n_chains) == 2**12
    with pytest.raises(ValueError, match="family 1 has 4096 chains"):
        C.all_chains(frame, most=4095)


def test_diagnostics_are_read_after_the_write(spark, tmp_path):
    sequences = spark.createDataFrame([(1, 0, "TACGTCA", 7), (1, 1, "GACGTTC", 7)], "family_id long, seq_idx int, bases string, len long")
    genes = spark.createDataFrame([(1, k, f"g{k}", "chr1", "+", 100, 150, 160, 300) for k in (0, 1)], "family_id long, seq_idx int, gene string, chr string, strand string, region_start long, gene_start long, gene_end long, region_end long")
    seen = P.Diagnostics()
    found = P.discover(sequences, genes, 3, diagnostics=seen)
    found["mem"].write.parquet(f"file://{tmp_path}/mem")
    found["cns"].write.parquet(f"file://{tmp_path}/cns")
    got = seen.read()
    assert got["sequences"] == {"rows": 2, "symbols": 14, "longest": 7}
    assert got["repeats"] == {"rows": 2, "longest": 4} and got["outside_genes"]["rows"] == 2
    assert got["anchors"]["rows"] == got["mem"]["rows"] == got["cns"]["rows"] == 1


def test_diagnostics_of_families_without_matches(spark):
    sequences = spark.createDataFrame([(1, 0, "AAAA", 4), (1, 1, "CCCC", 4)], "family_id long, seq_idx int, bases string, len long")
    genes = spark.createDataFrame([(1, k, f"g{k}", "chr1", "+", 100, 150, 160, 300) for k in (0, 1)], "family_id long, seq_idx int, gene string, chr string, strand string, region_start long, gene_start long, gene_end long, region_end long")
    seen = P.Diagnostics()
    P.discover(sequences, genes, 3, diagnostics=seen)
    got = seen.read()
    assert got["sequences"]["rows"] == 2 and [got[k]["rows"] for k in ("anchors", "mem", "cns")] == [0, 0, 0]


def test_one_search_for_several_k(spark):
    rnd = random.Random(3)
    core = "".join(rnd.choice("ACGT") for _ in range(50))
    bases = [(1, k, core[: 20 + k] + "N" + core[25:], 0) for k in range(3)]
    sequences = spark.createDataFrame(bases, "family_id long, seq_idx int, bases string, len long").withColumn("len", F.length("bases").cast("long"))
    genes = spark.createDataFrame([(1, k, f"g{k}", "c", "+", 1, 500, 510, 600) for k in range(3)], "family_id long, seq_idx int, gene string, chr string, strand string, region_start long, gene_start long, gene_end long, region_end long")
    columns = ["step", "len", "abs_pos", "word"]
    many = P.discover_many(sequences, genes, [4, 9, 21])
    for k in (4, 9, 21):
        own = P.discover(sequences, genes, k)["cns"]
        assert sorted(map(str, many.where(F.col("k") == k).select(*columns).collect())) == sorted(map(str, own.select(*columns).collect()))
