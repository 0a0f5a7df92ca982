"""License scans, fill-in-middle and the prefix trie against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.llm import fillmiddle, license, prefixtrie
from lociweave.llm.common import Scratch

DOCS = "doc_id long, text string, found string, w int, hits int"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1, 2) for k, t in enumerate(texts)], DOCS)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_truth(text):
    w = WORD.findall((text or "").translate(UPPER))
    at = [(i, label) for label, phrase in license.BASE for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


LICENSED = [
    None, "", "?!", "Licensed under CC BY-NC 4.0.", "all rights. Reserved! ALL-RIGHTS reserved all rights reserved", "cc cc by by cc by", "general public general public license",
    "This work is licensed under the GNU General Public License, version 3.", "the GNU Lesser General Public License", "Released under the MIT license.", "a mit license", "ünder all rights reserved", "all rights reserveds",
    "Redistribution, and use in source and binary forms with some modification, are permitted", "x " * 300_000 + "cc by", "license " * 50_000,
]


def test_license_scan(spark):
    rows = {r.doc_id: r for r in license.labelled(docs_of(spark, LICENSED)).collect()}
    assert len(rows) == len(LICENSED)
    for k, text in enumerate(LICENSED):
        r = rows[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_truth(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    label = lambda k: rows[k].labels
    assert (label(3), label(7), label(8), label(9)) == ("cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "gpl,lgpl", "mit")
    assert label(10) == "" and rows[10].score == 0, "two words of five are no licence line"
    # An inserted word shifts what is behind it; the words before it and the key phrase are most of the template.
    assert label(13) == "bsd" and 0.6 <= rows[13].score < 1


def test_license_scan_of_random_words(spark):
    rnd = random.Random(5)
    words = "all rights reserved general public license cc by the".split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(60))) for _ in range(200)]
    for r in license.labelled(docs_of(spark, texts)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_truth(texts[r.doc_id])


def test_license_scan_without_rows_or_licences(spark):
    assert license.labelled(docs_of(spark, [])).collect() == []
    twice = spark.createDataFrame([(None, "nothing here")] * 2, "doc_id long, text string")
    assert [(r.doc_id, r.n_words, r.labels) for r in license.labelled(twice).collect()] == [(None, 2, "")] * 2


TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def cut_truth(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    seed = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(seed[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rnd = random.Random(3)
    signs = ["a", "Zz", "word", " ", "\n", "é", "日本", "𝄞", "<", "S>", "<P", ">", "9", "́", "\r\n", "\x00"]
    texts = [None, "", "x", "<", "a<P>b", "<M>", "é" * 50, "word " * 400_000, "a" * 2_000_000]
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.randrange(200))) for _ in range(300)]
    rows = fillmiddle.fill_in_middle(docs_of(spark, texts)).withColumn("back", fillmiddle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut_truth(r.doc_id, texts[r.doc_id])
        assert r.back == (texts[r.doc_id] or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing_and_of_repeated_rows(spark):
    assert fillmiddle.digests(docs_of(spark, [])).collect() == []
    rows = spark.createDataFrame([(None, "ab cd")] * 2 + [(None, None)], "doc_id long, text string")
    got = fillmiddle.digests(rows).collect()
    assert sorted(r.n for r in got) == [0, 3, 3] and {r.restored_sha256 for r in got} == {hashlib.sha256(x).hexdigest() for x in (b"", b"ab cd")}


@pytest.mark.parametrize("error", [0, 3, 127])
def test_rank_index_is_exact(error):
    rnd = np.random.default_rng(7)
    groups = [np.cumsum(rnd.integers(0, 40, n)) for n in (1, 2, 3000, 1, 17, 5000)] + [np.cumsum(rnd.geometric(0.001, 2000))]
    values, firsts = np.concatenate(groups), np.cumsum([0, *map(len, groups)])[:-1]
    index = fillmiddle.RankIndex(values, firsts, error)
    assert (index(np.arange(len(values))) == values).all()
    assert np.abs(index.residual.astype(int)).max() <= error


def test_perfect_hash_is_minimal_and_verified():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    other = keys ^ np.uint64(5)
    table = prefixtrie.PerfectHash(keys, other)
    assert sorted(table(keys, other)) == list(range(len(keys)))
    assert (table(keys, keys) == -1).all() and (table(other, other) == -1).all()
    with pytest.raises(ValueError):
        prefixtrie.PerfectHash(keys[[0, 0]], keys[[0, 0]])


def trie_truth(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            m = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, m, role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        words = len([w for w in re.split("[\x20\x09-\x0d]+", node[-1][1]) if w]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(own) - 1) * words
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), kids[n], leaves[n], saved[n], digest(n)) for n, m in members.items())


def trie(spark, rows, segment=prefixtrie.SEGMENT):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn int, role string, text string, part int, seg int")
    out = prefixtrie.conversation_trie(frame.repartition(5), segment).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


@pytest.mark.parametrize("segment", [2, 3, 1024])
def test_trie_equals_brute_force(spark, segment):
    rnd = random.Random(segment)
    pool = ["a b", "c", "", None, "d  e\tf", "g\xa0h"]
    rows = []
    for c in [*range(0, 70), *range(2001, 2019), 5000]:
        if c % 9 != 4 and c != 20:
            rows += [(c, t if rnd.random() > 0.05 else None, rnd.choice(["user", "user", None]), rnd.choice(pool)) for t in range(rnd.randrange(1, 9))]
    rows += [(41, t, "user", "same") for t in range(40)] + [(c, t, "user", "same") for c in range(42, 58) for t in range(rnd.randrange(30, 41))]
    rows += [(7, 3, "user", "a b")] * 3 + [(None, 1, "user", "lost")]
    assert trie(spark, rows, segment) == trie_truth(rows)


def test_trie_of_hot_conversations(spark):
    """One conversation holds a third of all rows, and a third of all conversations are copies."""
    rows = [(60, t, "user", f"turn {t}") for t in range(900)]
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1300) for t in range(3)]
    rows += [(c, t, "user", f"own {c} {t}" if t else "first") for c in range(3000, 3300) for t in range(3)]
    assert trie(spark, rows, 64) == trie_truth(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie(spark, []) == []
    short = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0][:5]
    rows = [(c, 0, "user", "x y") for c in short]
    assert trie(spark, rows) == trie_truth(rows) and len(trie_truth(rows)) == 1


def test_digest_of_two_prefixes_fails(spark):
    rows = spark.createDataFrame([(1, 0, 1, b"a", 1, 5, 6, 0, 0), (2, 0, 1, b"b", 1, 5, 6, 0, 0)], "conv_id long, seg long, depth long, m binary, w long, d1 long, d2 long, p1 long, p2 long")
    with pytest.raises(Exception, match="share a digest"):
        prefixtrie.enumerated(rows).collect()


def test_openings_are_carried_over_partitions(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(40, 60) for t in range(5)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        scratch = Scratch()
        got = prefixtrie.placed(prefixtrie.turns_of(frame), scratch).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.conv_id, r.p) for r in got) == [(c, t) for c, t, *_ in rows]
    assert {r.n_base for r in got if r.conv_id > 40} == {3}


def test_packing_deals_repeated_rows_over_groups(spark):
    """20,000 equal rows and groups of 1,000: none holds more than twice as many; and all rows are packed."""
    import public_tokenizers

    from lociweave.llm import packing

    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same short text").alias("text"))
    found = packing.pack_documents(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, group_docs=1000)
    groups = found.where("start = 0").groupBy(F.floor(F.col("sequence_id") / packing.GROUP_IDS)).count().collect()
    assert sum(r["count"] for r in groups) == 20_000 and max(r["count"] for r in groups) <= 2000


def test_repeated_rows_bring_their_spans_once(spark):
    from lociweave.llm import suffixdedup

    text = "".join(random.Random(4).choice("abcdefgh ") for _ in range(900))
    rows = spark.createDataFrame([(None, text)] * 100, "doc_id long, text string")
    spans = suffixdedup.with_spans(suffixdedup._keyed(rows, "text"), 400).select(F.size("spans").alias("n")).collect()
    assert len(spans) == 100 and max(r.n for r in spans) <= 900
    got = {(r.n_bytes, r.n_removed, r.n_spans) for r in suffixdedup.suffix_dedup(rows).collect()}
    assert got == {(900, 900, 1)}


def test_toxicity_distributions_sum_to_one():
    """Over all units, behind each predecessor, in both classes and for each lean; and a bigram's evidence is their ratio."""
    from lociweave.llm.toxicity import Counts

    rnd = np.random.default_rng(6)
    size, rows = 9, 60
    key = np.unique(np.stack([rnd.integers(0, 2, rows), rnd.integers(0, size * size, rows)], axis=1), axis=0)
    label, pair = key[:, 0], key[:, 1]
    n = rnd.integers(1, 6, len(pair))
    continued, before = np.zeros((2, size)), np.zeros((2, size))
    np.add.at(continued, (label, pair % size), 1)
    np.add.at(before, (label, pair // size), n)
    shared = rnd.random(size)
    table = Counts([f"u{k}" for k in range(1, size)], label, pair, n, continued, before, shared / shared.sum())
    for lean in (0.5, 8.0):
        keys, p, left, unit = table.distributions(lean)
        model = table.model(lean)
        for v in range(size):
            whole = left[:, v, None] * unit
            own = keys // size == v
            whole[:, keys[own] % size] = p[:, own]
            assert np.allclose(whole.sum(axis=1), 1)
            for w in range(size):
                at = np.flatnonzero(keys == v * size + w)
                evidence = model.bigram[at[0]] if len(at) else model.unit[w] + model.after[v]
                assert np.isclose(evidence, np.log(whole[1, w] / whole[0, w]), atol=1e-5)


def test_toxicity_tables_are_alike_in_any_stretches():
    """Unsorted rows, and stretches from one predecessor to all."""
    from lociweave.llm.toxicity import Counts

    rnd = np.random.default_rng(7)
    size = 30
    key = rnd.permutation(np.unique(np.stack([rnd.integers(0, 2, 500), rnd.integers(0, size * size, 500)], axis=1), axis=0))
    label, pair, n = key[:, 0], key[:, 1], rnd.integers(1, 6, len(key))
    continued, before = np.zeros((2, size)), np.zeros((2, size))
    np.add.at(continued, (label, pair % size), 1)
    np.add.at(before, (label, pair // size), n)
    table = Counts([f"u{k}" for k in range(1, size)], label, pair, n, continued, before, np.full(size, 1 / size))
    assert table.keys.tolist() == sorted(set(pair.tolist()))
    whole = table.distributions(8.0, together=10_000)
    for together in (1, 40):
        assert all(np.allclose(a, b) for a, b in zip(table.distributions(8.0, together), whole, strict=True))
        assert np.allclose(table.model(8.0, together).bigram, np.log(whole[1][1] / whole[1][0]), atol=1e-5)


def test_toxicity_words_are_the_patterns_at_every_code_point():
    from lociweave.llm.toxicity import WORD, words_of

    texts = ["", "".join(map(chr, range(256))), *(f"a{chr(c)}B {chr(c)}{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000)]
    assert all(words_of(t) == WORD.findall(t.lower()) for t in texts)


def test_toxicity_bigrams_and_features_of_a_slice_are_those_of_its_texts():
    """A slice of texts, blank and hidden-letter ones among them, gives each text what it has alone and by the definition."""
    from lociweave.llm.toxicity import STRONG, TOP, ToxicityModel, Units, words_of

    rnd = random.Random(5)
    words = ["alpha", "alphabet", "alphabets", "beta", "né", "日本", "zz", "x1y"]
    texts = ["", " ", "1 2", *(" ".join(rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(60)), "\xa0alpha\x85beta", ""]
    names = sorted(["alpha", "alph*", "alpha*", "beta", "né", "x"])
    size = len(names) + 1
    ids = {x: k + 1 for k, x in enumerate(names)}

    def unit(word):
        longest = [ids[f"{word[:n]}*"] for n in range(len(word) - 1, 3, -1) if f"{word[:n]}*" in ids]
        return ids.get(word, longest[0] if longest else 0)

    model = ToxicityModel(names, np.linspace(-3, 3, size), np.linspace(1, -1, size), np.arange(0, size * size, 3), np.linspace(-4, 4, len(range(0, size * size, 3))))
    keys, counts = Units(names).bigrams(texts)
    found = model.features(keys, counts)
    assert found.shape == (len(texts), 3 + len(TOP)) and (found[0] == 0).all()
    for text, own, row in zip(texts, np.split(keys, np.cumsum(counts)[:-1]), found, strict=True):
        units = [0, *map(unit, words_of(text))]
        assert own.tolist() == [a * size + b for a, b in zip(units, units[1:])]
        by_key = {k: model.bigram[k // 3] if k % 3 == 0 else model.unit[k % size] + model.after[k // size] for k in own.tolist()}
        top = sorted((e for e in by_key.values() if e > 0), reverse=True)
        mean = sum(by_key[k] for k in own.tolist()) / max(len(own), 1)
        expected = [mean, *(sum(top[:k]) / k for k in TOP), min(TOP[-1], sum(e > STRONG for e in top)), np.log1p(len(own))]
        assert np.allclose(row, expected)
        assert np.allclose(model.features(own, np.array([len(own)]))[0], row)
