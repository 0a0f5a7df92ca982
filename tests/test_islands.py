"""Islands that two sequences share: in one array, by shuffles and by their SQL; starts of K-mers are never broadcast."""

import random

import numpy as np
import pytest

from lociweave import queries as core
from lociweave.functions import bytetables as B
from lociweave.operators import repeats as R
from lociweave.operators import smallfamilies as M

NAMES = ["family_id", "seq_a", "seq_b", "pos_a", "pos_b", "len"]


def rows_of(df):
    return sorted(map(tuple, df.select(NAMES).collect()))


def drawn(seed):
    draw, rows = random.Random(seed), []
    for family in range(24):
        base = "".join(draw.choice("ACGTN" + "AC" * (family % 4)) for _ in range(draw.choice([0, 6, 7, 30, 90, 200])))
        for seq in range(family % 4 + 1):
            own = list(base)
            for _ in range(draw.choice([0, 1, 5])):
                if own:
                    own[draw.randrange(len(own))] = draw.choice("ACGTN")
            turn = draw.randrange(len(own) + 1) if family % 3 else 0
            rows.append((family, 3 * seq, "".join(own[turn:] + own[:turn])))
    return [*rows, (24, 0, "A" * 60), (24, 1, "NA" + "A" * 50 + "N"), (24, 2, "C" + "A" * 70 + "G")]


def plain(rows, k):
    """From all pairs of places, by their definition."""
    out = []
    for f, s, a in rows:
        for g, t, b in rows:
            if f != g or s >= t:
                continue
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] != b[j] or a[i] == "N" or i and j and a[i - 1] == b[j - 1] != "N":
                        continue
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] != "N":
                        n += 1
                    if n >= k:
                        out.append((f, s, t, i + 1, j + 1, n))
    return sorted(out)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(drawn(11), "family_id long, seq_idx int, bases string")


@pytest.mark.parametrize("k", [3, 7, 25])
def test_islands_equal_all_pairs_of_places(texts, k):
    want = plain(drawn(11), k)
    assert len(want) > 100
    assert rows_of(M.islands(texts, k)) == want
    assert rows_of(R.shuffled_islands(texts, k)) == want


def test_batches_and_rows_given_out_do_not_matter(texts, monkeypatch):
    for name, value in (("BATCH", 1), ("PIECE", 5), ("ROWS", 7)):
        monkeypatch.setattr(M, name, value)
    dealt = M._dealt(texts).toArrow().to_batches(max_chunksize=3)
    got = []
    for data, number, row, begins, table in M._laid(iter(dealt)):
        family, seq = table.column("family_id").to_pylist(), table.column("seq_idx").to_pylist()
        for a, b, size in M._islands(data, number, np.unique(begins), 3):
            assert len(a) <= 7
            got += [(family[row[x]], seq[row[x]], seq[row[y]], x - begins[row[x]], y - begins[row[y]], n) for x, y, n in zip(a.tolist(), b.tolist(), size.tolist())]
    assert sorted(got) == plain(drawn(11), 3)


def documents(spark, folder):
    """Small and large families, copies, characters of several bytes, ids and texts that are not there."""
    draw = random.Random(2)
    word = lambda n: "".join(draw.choice("abcdefg") for _ in range(n))
    line, long = " ".join(word(draw.choice([3, 8, 12])) for _ in range(12)), word(M.RUN + 50)
    rows = [(0, line), (1, line), (2, line[9:]), (3, line + " " + line), (4, None), (5, line[::-1]), (7, line), (None, line), (None, "abcdefgh"), (9, long), (10, long[5:] + " " + line), (11, "x" + long[:700])]
    rows += [(12, "a" * 300), (14, "a" * (M.RUN + 9)), (15, line[4:]), (16, line + "Zé\U0001f600" + line), (17, line), (18, ""), (19, "abcdef"), (20, "abcdefgh"), (21, "abcdefgh"), (22, "tsrqponmlkjihgfedcba")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_query_matches_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    folder = documents(spark, tmp_path)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = core.QUERIES["lce_islands"](spark, folder)
    assert got.dtypes == [("family_id", "bigint"), ("seq_a", "int"), ("seq_b", "int"), ("pos_a", "bigint"), ("pos_b", "bigint"), ("len", "bigint")]
    want = sorted(db.sql(f"SELECT {', '.join(NAMES)} FROM ({core.ORACLE_SQL['lce_islands']})").fetchall())
    assert {r[0] for r in want} >= {0, 1, 3, 4, 5} and rows_of(got) == want


def test_repeated_sequences_are_numbered_together(spark):
    """As before: pairs on a diagonal are numbered in order of place, whichever copy they come from."""
    rows = [(0, 0, "ACGTACGTTACG"), (0, 0, "CCACGTACG"), (0, 1, "ACGTACGTTACC"), (0, 1, "ACGTACGTTACC"), (1, 0, "ACGTACG"), (1, 1, "TACGTACGT"), (None, 0, "ACGTACGT"), (None, 1, "ACGTACGT"), (2, None, "ACGTACGT"), (2, 1, "ACGTACGT")]
    diagonals = {}
    for f, s, a in rows:
        for g, t, b in rows:
            if f is not None and s is not None and t is not None and f == g and s < t:
                for i in range(len(a) - 4):
                    for j in range(len(b) - 4):
                        if a[i : i + 5] == b[j : j + 5]:
                            diagonals.setdefault((f, s, t, j - i), []).append(i + 1)
    want = {}
    for (f, s, t, shift), places in diagonals.items():
        for n, i in enumerate(sorted(places)):
            want.setdefault((f, s, t, shift, i - n), []).append(i)
    want = sorted((f, s, t, min(places), min(places) + shift, len(places) + 4) for (f, s, t, shift, _), places in want.items())
    texts = spark.createDataFrame(rows, "family_id long, seq_idx int, bases string")
    assert {r[0] for r in want} == {0, 1} and rows_of(R.islands(texts, 5)) == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_starts_are_not_broadcast(spark, tmp_path, texts):
    spark.createDataFrame([(0, "abcdefgh"), (2, "abcdefghi")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = core.QUERIES["lce_islands"](spark, str(tmp_path))
    assert "Broadcast" not in plan_of(found) and rows_of(found) == [(0, 0, 2, 1, 1, 8)]
    starts = R.kmers(texts, 7).withColumn("before", R.F.lit("A"))
    assert "Broadcast" not in plan_of(R.kmer_pairs(starts)) and "Broadcast" not in plan_of(R.island_edges(starts, "before"))


def test_pairs_are_made_at_edges_only(spark):
    """Of 200 x 300 pairs of starts on 499 diagonals, those at which an island begins: none in stretches of one symbol is made twice."""
    rows = spark.createDataFrame([(0, 0, "A" * 206), (0, 1, "A" * 306)], "family_id long, seq_idx int, bases string")
    starts = R.clear_windows(rows, 7, 8).selectExpr("family_id", "seq_idx", "pos", "substring(raw, 1, 7) kmer", "if(pos = 1, '', before) before")
    assert R.island_edges(starts, "before").count() == M.islands(rows, 7).count() == 499


def test_letters_are_folded_in_slices(spark, monkeypatch):
    """Slices of any size, nulls and empty texts, forth and back in one go, give what whole batches give."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    texts = ["", None, "aZé\U0001f600x", "ACGTNNacgt\n", "é", "Nn", "ACGT" * 30 + "NA", None, ""]
    want = [None if x is None else "".join({"a": "A", "b": "C"}.get(c, c if c in "ACGT" else "N") for c in x) for x in texts]
    turned = [None if x is None else x[::-1].translate(str.maketrans("ACGT", "TGCA")) for x in want]
    table, opposite = B._table("abACGT", "ACACGT", "N"), B._table("ACGT", "TGCA")
    for size in (1, 5, 1 << 22):
        monkeypatch.setattr(B, "SLICE", size)
        for own in (pa.array(texts, pa.string()), pa.array(["x", *texts], pa.string()).slice(1)):
            folded = B._in_slices(lambda x: B._mapped(x, table), own)
            assert folded.to_pylist() == want
            assert B._in_slices(lambda x: B._reversed(x, opposite), folded).to_pylist() == turned
        assert len(B._in_slices(lambda x: B._mapped(x, table), pa.array([], pa.string()))) == 0
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts * 2)], "k int, text string").repartition(2)
    got = df.select("k", B.mapped_or_reversed(F.col("text"), F.col("k") >= len(texts), "abACGT", "ACACGT", "N", "ACGT", "TGCA").alias("x"))
    assert {r.k: r.x for r in got.collect()} == dict(enumerate(want + turned))
