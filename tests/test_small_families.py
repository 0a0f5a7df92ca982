"""Small families in one array, next to the same by shuffles, and letters mapped by tables of bytes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.functions import bytetables
from lociweave.functions import sequences as S
from lociweave.operators import repeats as R
from lociweave.operators import smallfamilies as M


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def texts(spark):
    draw, rows = random.Random(5), []
    for family in range(30):
        base = "".join(draw.choice("ACGTN" + "AC" * (family % 4)) for _ in range(draw.choice([0, 6, 7, 30, 90, 300])))
        for seq in range(family % 4 + 1):
            own = list(base)
            for _ in range(draw.choice([0, 1, 5])):
                if own:
                    own[draw.randrange(len(own))] = draw.choice("ACGTN")
            turn = draw.randrange(len(own) + 1) if family % 3 else 0
            rows.append((family, seq, "".join(own[turn:] + own[:turn])))
    return spark.createDataFrame(rows, "family_id long, seq_idx int, bases string")


@pytest.mark.parametrize("k", [3, 7])
def test_small_families_equal_shuffles(texts, k):
    assert rows_of(M.occurrences(texts, k)) == rows_of(R.spelled(R.shuffled_words(texts, k), texts))
    assert rows_of(M.words(texts, k)) == rows_of(R.shuffled_right_maximal(texts, k))
    for kept, suppress in (("maximal", True), ("diverse", False)):
        assert rows_of(M.occurrences(texts, k, kept)) == rows_of(R.shuffled_repeats(texts, k, suppress))


def test_large_families_go_by_shuffles(spark, monkeypatch):
    draw = random.Random(3)
    long = "".join(draw.choice("ACGT") for _ in range(M.RUN + 9))
    rows = [(0, 0, "ACGTACGTN"), (0, 1, "NACGTACGT"), (1, 0, long), (1, 1, "N" + long), (2, 0, "ACGTACGTNNAACGTACG"), (2, 0, "CACGTACGT"), (None, None, "ACGTACGTACGTN")]
    texts = spark.createDataFrame(rows, "family_id long, seq_idx int, bases string")
    assert [r.family_id for r in M.large_families(texts).orderBy("family_id").collect()] == [None, 1, 2]
    own = texts.where("family_id in (0, 1)")
    assert rows_of(R.maximal_repeats(own, 7)) == rows_of(R.shuffled_repeats(own, 7))
    monkeypatch.setattr(M, "FAMILY", 17)
    assert 0 in [r.family_id for r in M.large_families(texts).collect()]


def test_batches_and_rows_given_out_do_not_matter(texts, monkeypatch):
    whole = rows_of(M.occurrences(texts, 3))
    for name, value in (("BATCH", 1), ("PIECE", 5), ("ROWS", 7)):
        monkeypatch.setattr(M, name, value)
    dealt = M._dealt(texts.where("family_id is not null")).toArrow().to_batches(max_chunksize=3)
    starts = [own for _, own in M._batches(iter(dealt))]
    assert sum(int(own.sum()) for own in starts) == texts.where("bases <> ''").select("family_id").distinct().count()
    assert all(own[0] and own.sum() == 1 for own in starts)
    n = sum(len(found.n) and int((found.last - found.first + 1).sum()) for found, *_ in M._families(iter(dealt), 3))
    assert n == len(whole)


def test_letters_by_tables(spark):
    texts = ["", None, "aZé\U0001f600x", "ACGTNNacgt\n", "é", "Nn", "ACGT" * 30 + "NA"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string").repartition(2)
    plain = S.normalize(F.translate(F.lower("text"), "abcz", "ACGT"))
    table = bytetables.mapped(F.lower("text"), "abczACGT", "ACGTACGT", "N")
    got = df.select(plain.alias("a"), table.alias("b"), S.reverse_complement(plain).alias("c"), bytetables.reversed_by(table, "ACGT", "TGCA").alias("d")).collect()
    assert len(got) == len(texts)
    assert all(r.a == r.b and r.c == r.d for r in got)
    runs = {r.k: r.n for r in df.select("k", bytetables.longest_stretch(F.col("text"), "ACGTN", "N").alias("n")).collect()}
    assert runs == {0: 0, 1: None, 2: -1, 3: -1, 4: -1, 5: -1, 6: 120}
    assert np.all(M.CODES[[ord(c) for c in M.SYMBOLS]] > 0)
