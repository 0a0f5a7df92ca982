"""Operators on whole texts: brute force, round trips, edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.llm import langid, neardup, packing, quality, suffixdedup, tokencount, toxicity
from lociweave.llm.components import components
from lociweave.llm.decontam import decontaminate, uncontaminated

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long"


def docs_of(spark, texts, langs=None):
    """doc_id from 0; a further column has a name that results also use."""
    return spark.createDataFrame([(k, t, (langs or ["en"] * len(texts))[k], "s", len(t or ""), 7) for k, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(rnd, words=60):
    return " ".join("".join(rnd.choice("aeiou" if k % 2 else "bdglmnrst") for k in range(rnd.randint(2, 8))) for _ in range(words))


# Suffix dedup ------------------------------------------------------------------------------------------------------


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(r)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def suffix_cases():
    rnd = random.Random(1)
    passage, long = prose(rnd, 90), prose(rnd, 400)
    texts = [None, "", "short", long, long, "é" * 900, "ab" * 700, "ab" * 350 + "c", "Und " * 300, prose(rnd) + passage + prose(rnd), prose(rnd) + passage, passage[:450] + prose(rnd), passage[30:431], "x" + passage[100:]]
    texts += [prose(rnd, 20) + passage[k : k + 399 + k % 3] + prose(rnd, 20) for k in range(0, 90, 9)]
    return [*texts, long[:500] + "!" + long[500:], long[200:], "a" * 400, "b" * 399, "b" * 399 + "c"]


def test_suffix_dedup_is_exact(spark):
    texts = suffix_cases()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.suffix_dedup(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == removed(texts, 400)


def test_suffix_dedup_of_repeated_rows_nulls_and_empty_tables(spark):
    text = prose(random.Random(2), 100)
    rows = spark.createDataFrame([(1, text), (1, text), (None, "lone " * 3), (2, None)], "doc_id long, text string")
    got = sorted(suffixdedup.suffix_dedup(rows).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_removed) for r in got] == [(1, len(text)), (1, len(text)), (2, 0), (None, 0)]
    assert suffixdedup.suffix_dedup(empty(spark)).count() == 0
    kept = suffixdedup.without_repeats(docs_of(spark, [text, "keep this", text + " é", None]))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {0: ("", 0), 1: ("keep this", 9), 2: (" é", 2), 3: (None, None)}


# Token counts ------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(3)
    texts = ["", "a", " ", "  x ", "▁▁a", "<s> hi </s>", "a\n b\r\n\tc", "漢字かな", "\x00", " " * 300, "ab" * 3000, "=-" * 2500, "é ﬁ ①"]
    texts += ["".join(rnd.choice("abe ▁\n=漢é .0") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    got = {r.doc_id: r for r in tokencount.count_tokens(docs_of(spark, [*texts, None]), path, limit=50).collect()}
    for k, t in enumerate([*texts, ""]):
        n = len(library.encode(t))
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len(t.encode()), n > 50), repr(t)
    assert tokencount.count_tokens(empty(spark), path).count() == 0


# Language ----------------------------------------------------------------------------------------------------------


def test_language_backs_off_and_rejects(spark):
    english, french = "the house and the garden with other things".split(), "la maison et le jardin avec des autres choses".split()
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(x) for _ in range(20)) for _ in range(40) for x in (english, french)]
    langs = ["en", "fr"] * 40
    extra = [None, "", "123 !!", "thingsother", "jardinmaison"]
    got = {r.doc_id: r for r in langid.language_id(docs_of(spark, texts + extra, langs + [None] * 5)).collect()}
    assert all(got[k].lang_pred == langs[k] for k in range(80))
    assert [got[80 + k].lang_pred for k in range(5)] == ["und", "und", "und", "en", "fr"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert langid.recognised(docs_of(spark, texts + extra, langs + [None] * 5)).count() == 82
    assert langid.language_id(empty(spark)).count() == 0
    nothing = langid.language_id(docs_of(spark, ["the house"], [None])).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)


def test_language_of_number_signs(spark):
    texts = ["10² ①", "the house 10² ① ½", "la maison 10² ① Ⅷ", "x²", "② ³"]
    langs = ["en", "en", "fr", "en", None]
    got = {r.doc_id: r.lang_pred for r in langid.predict_language(docs_of(spark, texts), langid.fit_language_model(docs_of(spark, texts * 3, langs * 3))).collect()}
    assert got == {0: "und", 1: "en", 2: "fr", 3: "en", 4: "und"}
    assert langid.words_of("Aé10² x½y ①") == ["aé", "x", "y"]
    assert langid.recognised(docs_of(spark, texts * 3, langs * 3)).where("doc_id % 5 in (0, 4)").count() == 0


# Decontamination ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast_rows", [60_000, 0])
def test_decontamination_is_exact(spark, broadcast_rows):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["the", "of", "Cat", "dog", "über", "run", "7"])
    items = [" ".join(word() for _ in range(n)) for n in (3, 4, 12, 14, 10, 9)] + [None, "", "---", "the of the"]
    texts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(40)] + [None, "", f"x {items[2]} y", f"{items[3]}; {items[3]}", items[4].upper()]
    parse = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(0, items[0], "x")], "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in decontaminate(docs_of(spark, texts), rows, broadcast_rows=broadcast_rows).collect()}
    for k, t in enumerate(texts):
        w, hit, named = parse(t), set(), set()
        for i, item in enumerate(items):
            own = parse(item)
            n = min(10, len(own))
            for s in range(len(own) - n + 1 if own else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[s : s + n]:
                        hit |= set(range(p, p + n))
                        named.add(str(i))
        want = (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit))
        assert (got[k].n_words, got[k].n_hit, got[k].n_items, got[k].items_sha256, got[k].contaminated) == want


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(None, "a b c"), (1, "q r s")], "item_id long, text string")
    rows = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "x")], "doc_id long, text string")
    got = decontaminate(rows, items).collect()
    assert sorted((str(r.doc_id), r.n_hit, r.n_items) for r in got) == [("5", 3, 0), ("5", 3, 0), ("None", 0, 0)]
    assert decontaminate(empty(spark), items).count() == 0
    assert decontaminate(rows, items.limit(0)).where("contaminated").count() == 0
    assert [r.text for r in uncontaminated(docs_of(spark, ["a b c", "clean", None]), items).orderBy("doc_id").collect()] == ["clean", None]


# Packing -----------------------------------------------------------------------------------------------------------


def test_packing_keeps_every_id_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(7)
    texts = [prose(rnd, rnd.randint(0, 900)) for _ in range(60)] + [None, "", "<|endoftext|>a<|endoftext|>", "é" * 5000]
    rows = packing.pack_documents(docs_of(spark, [*texts, texts[0]]), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, group_docs=30).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for k, t in enumerate([*texts, texts[0]]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(pieces[k], key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.01 * sum(r.length for r in rows)
    assert packing.pack_documents(empty(spark), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_packing_takes_runs_of_white_space_of_any_length(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    text = "a" + " " * 2_000_000 + "b<|endoftext|>" + "\n" * 2_000_000
    ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
    rows = sorted(packing.pack_documents(docs_of(spark, [text, "short"]), path, pattern).where("doc_id = 0").collect(), key=lambda r: r.start)
    assert rows[0].doc_tokens == len(ids) == sum(r.length for r in rows)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)
    # The fast encoder's own panics go to the library too.
    monkeypatch.setattr(packing, "SAFE_RUN", 10_000_000)
    assert packing.encode(" " * 1_000_000, path, pattern) == library.encode(" " * 1_000_000, add_special_tokens=False).ids


def test_first_fit_is_first_fit():
    rnd = random.Random(8)
    sizes = [rnd.randint(1, 100) for _ in range(200)]
    bins, tree = [100] * 200, packing.Bins(200, 100)
    for n in sizes:
        k = next(i for i, free in enumerate(bins) if free >= n)
        bins[k] -= n
        assert tree.place(n) == k


# Near-duplicates ---------------------------------------------------------------------------------------------------


def near_cases():
    rnd = random.Random(9)
    base = [prose(rnd, n).split() for n in (8, 20, 40, 90, 200)]
    texts = [None, "", "one two", "ONE  two", "one\ttwo three", " \n "]
    for w in base:
        texts.append(" ".join(w))
        for changes in (0, 1, 2, 4, 7):
            for _ in range(3):
                own = list(w)
                for _ in range(changes):
                    own[rnd.randrange(len(own))] = prose(rnd, 1)
                texts.append(" ".join(own))
    line = prose(rnd, 12)
    return texts + [f"{line} {prose(rnd, rnd.randint(2, 9))}" for _ in range(40)]


def near_truth(texts):
    def shingles(t):
        w = [x for x in re.split(r"[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(len(s), root(k), root(k) == k) for k, s in enumerate(sets)]


@pytest.mark.parametrize(("block", "close"), [(neardup.BLOCK, neardup.CLOSE), (3, 110), (2, -1)])
def test_near_duplicates_are_exact(spark, monkeypatch, block, close):
    """Also in blocks of a few members, and with close pairs that turn out to be no links."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CLOSE", close)
    monkeypatch.setattr(neardup, "SHARING", block)
    texts = near_cases()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == near_truth(texts)


def test_near_duplicates_at_the_threshold_are_found(spark):
    """600 pairs of 0.74 to 0.80, of texts of 12 to 400 words: just those at the threshold and above are linked."""
    rnd, texts = random.Random(22), []
    for _ in range(600):
        n = rnd.randint(12, 400)
        words = prose(rnd, n).split()
        # The first words of one text go: of n - 4 shingles, those of the other are what is left.
        cut = max(1, int((n - 4) * rnd.uniform(0.2, 0.26)))
        texts += [" ".join(words), " ".join(words[cut:])]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    for k in range(0, len(texts), 2):
        n, m = len(texts[k].split()) - 4, len(texts[k + 1].split()) - 4
        assert (got[k + 1] == k) == (100 * m >= 75 * n), (n, m)


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    rows = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (1, None), (2, "A B C D E F")], "doc_id long, text string")
    got = sorted(str((r.doc_id, r.component_id, r.kept)) for r in neardup.near_duplicates(rows).collect())
    assert got == ["(1, 1, True)", "(2, 2, True)", "(3, 2, False)", "(3, 2, False)", "(None, None, True)"]


def test_sketches_estimate_similarity():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 1 << 63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rnd.integers(0, 1 << 63, 60).astype(np.uint64)])
    s = neardup.sketches(np.concatenate([a, b, a[:1]]), np.array([300, 300, 1]))
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.15
    assert (s != np.iinfo(np.uint64).max).all()


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 140)}}


# Classifiers -------------------------------------------------------------------------------------------------------


def test_toxicity_and_quality_on_held_out_rows(spark):
    rnd = random.Random(10)
    texts, marks = [], []
    for k in range(400):
        words, toxic, good = prose(rnd, 50).split(), k % 4 == 0, k % 5 != 0
        if toxic:
            for _ in range(4):
                words[rnd.randrange(50)] = rnd.choice(["idiot", "scum", "moron"])
        texts.append(" ".join(words if good else [w.upper() + "!!" for w in words]))
        marks.append((k, int(good), int(toxic)))
    rows, labels = docs_of(spark, [*texts, None, ""]), spark.createDataFrame([*marks, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for got, column, folds, out in ((toxicity.toxicity(rows, labels), 2, 4, 2), (quality.quality(rows, labels), 1, 3, 1)):
        got = {r.doc_id: r for r in got.collect()}
        assert len(got) == 402 and all(0 <= r.score <= 1 for r in got.values())
        held = [k for k in range(400) if zlib.crc32(str(k).encode()) % folds == out]
        assert all(got[k].held_out for k in held)
        assert np.mean([got[k].predicted == marks[k][column] for k in held]) > 0.95
    odd = labels.unionByName(spark.createDataFrame([(3, 2, 2), (4, -1, 7)], labels.schema))
    assert toxicity.toxicity(rows, odd).count() == quality.quality(rows, odd).count() == 402
    assert toxicity.toxicity(rows, labels.limit(0)).where("score > 0").count() == 0
    assert {r.score for r in quality.quality(rows, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(empty(spark), labels).count() == 0 and quality.quality(empty(spark), labels).count() == 0


def test_toxicity_counts_continuations_and_keeps_rare_units(spark):
    rnd = random.Random(13)
    got = toxicity._corpus_continuations(docs_of(spark, ["a b", "a b", "c b", None]), ["a", "b", "c"])
    assert got.tolist() == [1, 2, 3, 2]  # and one: start a; a b and c b; start c
    assert toxicity._frequent_units(docs_of(spark, ["zork x zork", "zork once"])) == ["zork"]
    words = [prose(rnd, 1) for _ in range(60)]
    texts = [f"{prose(rnd, 9)} sanx onlyhere {words[k]} anywhere {prose(rnd, 9)}" if k % 2 else prose(rnd, 22) for k in range(60)]
    rows = docs_of(spark, texts).withColumn("label", F.col("doc_id") % 2)
    model = toxicity.fit_toxicity(rows, rows)
    evidence = dict(zip(model.names, model.unit[1:], strict=True))
    # As frequent, but behind one word only: little of it is left where the bigram is unknown.
    assert evidence["anywhere"] > evidence["onlyhere"] + 0.5


def test_nonnegative_risk_separates():
    rnd = np.random.default_rng(2)
    good, bad = rnd.normal(1, 1, (400, 3)), rnd.normal(-2, 1, (100, 3))
    model = quality.fit_nonnegative(rnd.normal(1, 1, (300, 3)), np.concatenate([good, bad]), 0.8)
    assert (model.scores(good) > 0.5).mean() > 0.93 and (model.scores(bad) < 0.5).mean() > 0.85


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_class_prior_is_estimated_from_unlabelled_scores(share):
    rnd = np.random.default_rng(7)
    n = int(4000 * share)
    unlabelled = rnd.permutation(np.concatenate([rnd.normal(1, 1, (n, 3)), rnd.normal(-2, 1, (4000 - n, 3))]))
    assert abs(quality.class_prior(rnd.normal(1, 1, (2000, 3)), unlabelled) - share) < 0.05
    one = np.ones((1, 3))
    assert 0 < quality.class_prior(one, one) < 1


def test_language_keeps_rare_languages_and_bounds_samples(spark):
    """A language of one row in 200 keeps its entries beside a frequent one; null doc_ids are sampled like others."""
    rnd = random.Random(20)
    common, rare = [prose(rnd, 1) for _ in range(400)], [prose(rnd, 1) for _ in range(12)]
    texts = [" ".join(rnd.choice(common) for _ in range(30)) for _ in range(398)] + [" ".join(rnd.choice(rare) for _ in range(30)) for _ in range(2)]
    rows = spark.createDataFrame([(None, t, "aa" if k < 398 else "zz") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit_language_model(rows, train_rows=50, entries=60)
    assert model.languages == ["aa", "zz"] and len(model.weights) <= 120
    asked = docs_of(spark, [" ".join(rare[:6]), texts[0]])
    assert [r.lang_pred for r in langid.predict_language(asked, model).orderBy("doc_id").collect()] == ["zz", "aa"]


def test_language_scores_equal_a_plain_model(spark):
    """Counts, frequencies and backoff by the definition, one dictionary for each language."""
    rnd = random.Random(21)
    texts = [prose(rnd, 12) if k % 2 else " ".join(w[::-1] + "k" for w in prose(rnd, 12).split()) for k in range(60)]
    langs = ["aa" if k % 2 else "bb" for k in range(60)]
    model = langid.fit_language_model(docs_of(spark, texts, langs))
    counts = {x: Counter() for x in ("aa", "bb")}
    for t, x in zip(texts, langs, strict=True):
        for w in langid.words_of(t):
            counts[x][0, w] += 1
            for order in range(1, 6):
                counts[x].update((order, g) for g in langid.grams(w, order))
    counts = {x: {e: n for e, n in c.items() if n >= 2} for x, c in counts.items()}
    totals = {(x, o): 1 + sum(n for (k, _), n in c.items() if k == o) for x, c in counts.items() for o in range(6)}
    weight = lambda x, o, e: np.log10(counts[x][o, e] / totals[x, o]) if (o, e) in counts[x] else -7.0
    known = set(counts["aa"]) | set(counts["bb"])

    def word(w):
        if (0, w) in known:
            return [weight(x, 0, w) for x in ("aa", "bb")]
        for order in range(min(5, len(w) + 2), 0, -1):
            own = [g for g in langid.grams(w, order) if (order, g) in known]
            if own:
                return np.mean([[weight(x, order, g) for x in ("aa", "bb")] for g in own], axis=0)
        return [-7.0, -7.0]

    asked = [prose(rnd, 9) for _ in range(20)]
    got = langid.predict_language(docs_of(spark, asked), model).orderBy("doc_id").collect()
    for t, r in zip(asked, got, strict=True):
        words = langid.words_of(t)
        mean = np.mean([word(w) for w in words], axis=0)
        odds = 10 ** ((mean - mean.max()) * min(len(words), langid.SCORE_WORDS))
        assert r.lang_pred == ("aa", "bb")[int(np.argmax(mean))] and abs(r.score - 1 / odds.sum()) < 1e-4


def test_blocks_of_strings_change_no_anchor():
    rnd = np.random.default_rng(3)
    sizes = [0, 900, 39, 40, 1500, 0, 41]
    data, offsets = rnd.integers(97, 100, sum(sizes)).astype(np.uint8), np.cumsum([0, *sizes])

    def strings(block):
        found = suffixdedup.segments_of(data, offsets, 40, 8, block)
        return sorted((r, f + k, f + a, h) for r, f, c, a, h, _ in zip(*(x.tolist() for x in found), strict=True) for k in range(c))

    want = strings(1 << 18)
    assert len(want) == sum(max(0, n - 39) for n in sizes)
    assert all(strings(block) == want for block in (1, 7, 64, 1000))


def test_language_learns_every_language_and_long_texts_in_parts(spark, monkeypatch):
    rnd = random.Random(22)
    own = {f"l{k:03d}": [prose(rnd, 1) + f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for _ in range(3)] for k in range(600)}
    rows = docs_of(spark, [" ".join(w * 2) for w in own.values()], list(own))
    model = langid.fit_language_model(rows)
    assert model.languages == sorted(own)
    texts = [" ".join(own["l599"]), " ".join(own["l003"] * 3000), ""]
    want = [langid.Scorer(model).text(t) for t in texts]
    assert [x for x, _ in want] == ["l599", "l003", "und"]
    # More new words than there are rows of weights at first.
    assert langid.Scorer(model).text(" ".join([*own["l007"] * 3000, *(f"q{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(3000))]))[0] == "l007"
    monkeypatch.setattr(langid, "AT_ONCE", 1200)  # two words at once
    monkeypatch.setattr(langid, "CACHE_WEIGHTS", 1200)
    small = langid.Scorer(model)
    got = [small.text(t) for t in texts]
    assert [x for x, _ in got] == [x for x, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    monkeypatch.setattr(langid, "MODEL_ENTRIES", 1200)
    assert langid.fit_language_model(rows).languages == sorted(own)


def test_quality_sums_and_bins_are_those_of_all_rows(spark):
    """Products and counts of scores over partitions equal those of one array; equal texts share a half."""
    rnd = np.random.default_rng(5)
    x, half = rnd.random((300, quality.WIDTH)).astype(np.float32), rnd.integers(0, 2, 300)
    rows = spark.createDataFrame([(int(h), bytearray(r.tobytes())) for h, r in zip(half, x, strict=True)], "half int, x binary").repartition(4)
    sums = quality._summed(rows)
    for k in (0, 1):
        assert np.allclose(sums[k], quality.products(x[half == k].astype(float)))
    models = [quality.QualityModel(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), rnd.normal(0, 0.1, quality.WIDTH + 1)) for _ in range(2)]
    counts = quality._counted(rows, models)
    for k in (0, 1):
        assert np.array_equal(counts[k], np.bincount(quality._bins(models[1 - k].scores(x[half == k].astype(float))), minlength=quality.BINS))
    assert [m.sum() for m in quality._summed(rows.limit(0))] == [0, 0]


def test_quality_hashed_counts_equal_a_plain_loop(monkeypatch):
    import pyarrow as pa

    texts = ["The cat, the Cat", "", None, "abc", "é abcd", "x" * 50, "the cat sat on the mat " * 30]
    found = quality.features(pa.array(texts, pa.string()))
    assert found.shape == (len(texts), quality.WIDTH) and (found[1] == 0).all() and (found[2] == 0).all()
    monkeypatch.setattr(quality, "AT_ONCE", 7)
    assert np.allclose(quality.features(pa.array(texts, pa.string())), found)
    size = quality.BUCKETS
    for t, row in zip(texts, found, strict=True):
        data = (t or "").lower().encode() if (t or "").isascii() else (t or "").encode()
        for grams, own in ((data.split(), row[quality.SURFACE : quality.SURFACE + size]), ([data[k : k + 4] for k in range(len(data) - 3)], row[quality.SURFACE + size :])):
            total = np.zeros(size)
            for g in grams:
                h = quality.Rolling(np.frombuffer(g, dtype=np.uint8), fold_case=True)(np.array([0]), np.array([len(g)]))
                total += quality._hashed(np.array([0]), h, 1)[0]
            assert np.allclose(own, total / max(np.linalg.norm(total), 1))


def test_quality_fit_is_the_least_risk():
    """The closed form has the least risk of points around it; where the inner part was negative, steps bring it up."""
    rnd = np.random.default_rng(6)
    p, u = rnd.normal(1, 1, (500, 3)), np.concatenate([rnd.normal(1, 1, (700, 3)), rnd.normal(-2, 1, (300, 3))])
    sums = [quality.products(x) for x in (p, u)]
    for prior, closed in ((0.3, True), (0.95, False)):
        model = quality.fit_products(*sums, prior)
        means = [quality._means(x, model.mean, model.scale) for x in sums]
        # Written out row by row.
        z = lambda x: (x - model.mean) / model.scale @ model.weights[1:] + model.weights[0]  # noqa: B023, E731
        outer, inner = quality._risk(model.weights, *means, prior)
        assert np.isclose(outer, prior * ((1 - z(p)) ** 2).mean() / 4)
        assert np.isclose(inner, ((1 + z(u)) ** 2).mean() / 4 - prior * ((1 + z(p)) ** 2).mean() / 4)
        if closed:
            assert inner > 0
            for _ in range(50):
                other = model.weights + rnd.normal(0, 0.05, 4)
                assert sum(quality._risk(other, *means, prior)) >= outer + inner - 1e-4
        else:
            first = np.linalg.solve(means[1] + np.diag([1e-9, *[quality.RIDGE] * 3]), 2 * prior * means[0][0] - means[1][0])
            assert quality._risk(first, *means, prior)[1] < -0.01 and inner > -0.01
