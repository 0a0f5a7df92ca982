"""Passages of words that several documents share, against a plain count of windows."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from lociweave.llm.passages import shared_spans
from lociweave.llm.suffixdedup import without_repeats
from tests.llm.test_text_operators import docs_of, empty, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(texts, words):
    """Kept bytes of each text without the windows that other texts hold too."""
    found = [list(WORD.finditer(t.encode())) for t in texts]
    holders = defaultdict(set)
    for k, ws in enumerate(found):
        for p in range(len(ws) - words + 1):
            holders[tuple(w[0] for w in ws[p : p + words])].add(k)
    out = []
    for t, ws in zip(texts, found, strict=True):
        raw, gone = t.encode(), set()
        for p in range(len(ws) - words + 1):
            if len(holders[tuple(w[0] for w in ws[p : p + words])]) > 1:
                gone |= set(range(ws[p].start(), ws[p + words - 1].end()))
        out.append(bytes(b for k, b in enumerate(raw) if k not in gone).decode())
    return out


def kept(spark, texts, words):
    rows = without_repeats(docs_of(spark, texts), length=1 << 20, more=lambda d: shared_spans(d, words)).collect()
    return [t for _, t in sorted((r.doc_id, r.text) for r in rows)]


def test_shared_passages_equal_a_plain_count(spark):
    rnd = random.Random(5)
    for letters, words in (("ab", 6), ("abcdé", 4), ("a", 9)):
        texts = ["".join(rnd.choice(letters) + rnd.choice([" ", "\n", "  ", " \t"]) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
        want = cut(texts, words)
        assert kept(spark, texts, words) == want and want != texts


def test_repeats_within_one_document_are_no_shared_passages(spark):
    rnd = random.Random(6)
    own, other = prose(rnd, 12), prose(rnd, 12)
    texts = [f"{own} x {own} y {own}", f"{other} z {other}", f"start {other}", ""]
    assert kept(spark, texts, 8) == cut(texts, 8) == [texts[0], " z ", "start ", ""]
    rows = spark.createDataFrame([(None, own), (None, own), (1, own + " tail"), (2, None)], "doc_id long, text string")
    got = without_repeats(rows, more=lambda d: shared_spans(d, 8)).collect()
    assert sorted(str(r.text) for r in got) == ["", "", " tail", "None"]
    assert without_repeats(empty(spark), more=lambda d: shared_spans(d, 8)).count() == 0


def test_the_pipeline_cuts_passages_of_over_50_words_below_400_bytes(spark):
    rnd = random.Random(7)
    short = lambda n: " ".join("".join(rnd.choice("bdglmnaeiou") for _ in range(rnd.randint(3, 6))) for _ in range(n))
    passage, fifty = short(51), short(50)
    assert len(passage.encode()) < 400
    ends = [short(40) for _ in range(8)]
    texts = [f"{ends[0]} {passage} {ends[1]}", f"{ends[2]} {passage.replace(' ', chr(10), 9)} {ends[3]}", f"{ends[4]} {fifty} {ends[5]}", f"{ends[6]} {fifty} {ends[7]}"]
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs_of(spark, texts), "").collect()}
    assert got == {0: f"{ends[0]}  {ends[1]}", 1: f"{ends[2]}  {ends[3]}", 2: texts[2], 3: texts[3]}


def test_op1_tells_passages_of_over_50_words_below_400_bytes(spark, tmp_path):
    """In columns of their own: what is removed is the contract's, strings of 400 bytes alone."""
    from lociweave.llm.registry import op1_suffix_dedup
    from tests.llm.test_text_operators import removed

    rnd = random.Random(8)
    short = lambda n: " ".join("".join(rnd.choice("bdglmnaeiou") for _ in range(rnd.randint(3, 6))) for _ in range(n))
    passage, other, fifty, long, twice = short(51), short(53), short(50), short(120), short(55)
    assert max(len(t.encode()) for t in (passage, other)) < 400 < len(long.encode())
    texts = [f"{short(40)} {passage} {short(40)}", f"{passage} {short(9)} {other}", f"é {other}", f"{fifty} {short(9)}", f"{short(9)} {fifty}"]
    texts += [f"{short(3)} {long}", f"{long} {short(3)}", f"{twice} - {twice}", "", None]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for _, r in sorted(got.items())] == removed(texts, 400)
    a, b, c = (len(t.encode()) for t in (passage, other, long))
    assert [(got[k].n_passages, got[k].n_passage_bytes) for k in range(len(texts))] == [(1, a), (2, a + b), (1, b), (0, 0), (0, 0), (1, c), (1, c), (0, 0), (0, 0), (0, 0)]
    assert [got[k].n_removed > 0 for k in range(len(texts))] == [False] * 5 + [True] * 2 + [False] * 3


def test_shared_windows_are_cut_at_each_place_of_a_document(spark):
    """Words that repeat on and on: equal segments of one document stand at many places of it."""
    texts = ["do " * 12 + "k " + "do " * 10 + "j", "r" + " do" * 9]
    assert kept(spark, texts, 9) == cut(texts, 9) == [" k  j", "r "]
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abc") + (" " + w) * rnd.randint(3, 15) for w in rnd.sample(["do", "re", "mi", "fa"], 3)) for _ in range(40)]
    assert kept(spark, texts, 8) == cut(texts, 8) != texts
