"""Chroma fingerprints and chat repair against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lociweave.llm import chat, chroma


def cheapest(roles):
    """Dijkstra's way over (turns read, state)."""
    import heapq

    heap, seen = [(0, 0, chat.START)], set()
    while heap:
        cost, k, s = heapq.heappop(heap)
        if (k, s) in seen:
            continue
        seen.add((k, s))
        if k == len(roles) and s == chat.ASSISTANT:
            return cost
        for b in range(1, 4):
            if (s, b) in chat.LEGAL:
                heapq.heappush(heap, (cost + chat.INSERT, k, b))
            if k < len(roles):
                label = 0 if chat.role_number(roles[k]) == b else chat.RELABEL
                if (s, b) in chat.LEGAL:
                    heapq.heappush(heap, (cost + label, k + 1, b))
                if s == b:
                    heapq.heappush(heap, (cost + label + chat.MERGE, k + 1, b))
    return None


@pytest.mark.parametrize("chunk", [4096, 2])
def test_repair_is_cheapest_and_legal(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rnd = random.Random(11)
    talks = [[rnd.choice(["user", "assistant", "system", "Human", "bot", "tool", None]) for _ in range(rnd.randint(1, 9))] for _ in range(40)]
    rows = [(c, t, r, None if t == 1 else f"c{c}t{t}", 9) for c, talk in enumerate(talks) for t, r in enumerate(talk)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long")).collect()
    assert len(got) == len(rows)
    for c, talk in enumerate(talks):
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: r.seq)
        assert [r.turn for r in own] == list(range(len(talk)))
        assert {r.cost for r in own} == {cheapest(talk)}
        spent = sum(chat.INSERT * r.inserted + chat.MERGE * ("merge" in r.action) + chat.RELABEL * ("relabel" in r.action) for r in own)
        assert spent == own[0].cost
        text = "".join(r.piece for r in own)
        states = [chat.START, *(chat.ROLES.index(x.split("|>")[0]) for x in text.split("<|") if x.split("|>")[0] in chat.ROLES[1:])]
        assert all(step in chat.LEGAL for step in zip(states, states[1:])) and states[-1] == chat.ASSISTANT
        assert all(f"c{c}t{t}" in text for t in range(len(talk)) if t != 1)


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (1, None, None, None)]
    got = chat.format_chats(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.conv_id), r.action, r.cost) for r in got) == [("1", "relabel", 5), ("None", "keep", 3), ("None", "merge", 3)]


def test_a_long_conversation_is_cut_into_chunks(spark):
    n = 3 * chat.CHUNK
    rows = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "'x' AS text")
    got = chat.format_chats(rows)
    assert got.where("action <> 'keep' OR inserted > 0").count() == 0 and got.count() == n


def sound(seed, seconds=12, rate=chroma.RATE):
    rnd = np.random.default_rng(seed)
    return chroma.melody(rnd.normal(0, 1, int(seconds * rate / chroma.HOP / 2)).repeat(2))


def test_rectangles_are_sums():
    frames = np.random.default_rng(1).random((40, 12))
    n = len(frames) - chroma.SPAN + 1
    want = []
    for t in range(n):
        code = 0
        for k, (kind, y, h, w) in enumerate(chroma.filters()):
            y = min(y, 12 - h)
            f = frames[t:]
            box = lambda a, b, c, d: f[a:b, c:d].sum()  # noqa: B023, E731
            m, half = y + h // 2, w // 2
            a, b = [(box(0, w, y, y + h), box(0, 16, 0, 12) * h * w / 192), (box(0, w, y, m), box(0, w, m, y + h)), (box(0, half, y, y + h), box(half, w, y, y + h)), (box(0, half, y, m) + box(half, w, m, y + h), box(0, half, m, y + h) + box(half, w, y, m))][kind]
            code |= int(chroma.GRAY[np.searchsorted(chroma.THRESHOLDS, np.log((1 + a) / (1 + b)))]) << 2 * k
        want.append(code)
    assert chroma.codes(frames).tolist() == want


def test_shifted_and_noisy_recordings_align(spark):
    a = sound(1)
    noisy = a + np.random.default_rng(2).normal(0, 0.02, len(a))
    rows = [(100, a), (1, a), (2, noisy[4 * chroma.HOP :]), (3, sound(3)), (4, np.zeros(9000)), (5, a[:200])]
    frame = spark.createDataFrame([(k, [float(x) for x in v], "u") for k, v in rows] + [(6, None, "u"), (None, [float(x) for x in a], "u")], "id long, samples array<double>, codes string")
    got = {r.id: r for r in chroma.aligned(chroma.fingerprints(frame)).collect()}
    assert got[100].copy_of == got[1].copy_of == 1 and got[None].copy_of == 1
    assert (got[2].n_matches, got[2].best_query, got[2].best_offset) == (1, 1, -4) and got[2].best_error < 0.2
    assert got[3].n_matches == 0 and got[5].n_codes == 0 and got[6].n_codes == 0 and got[6].copy_of is None
    assert chroma.aligned(chroma.fingerprints(frame.limit(0))).count() == 0


def plain_matches(prints, least_votes=chroma.LEAST_VOTES, most_error=chroma.MOST_ERROR):
    """(row, query) -> offset and error, by trying all offsets of all pairs."""
    out = {}
    for q, x in prints.items():
        for r, y in prints.items():
            best = None
            for o in range(-len(x) + 1, len(y)) if q % 100 == 0 and q != r else ():
                pairs = [(int(x[k]), int(y[k + o])) for k in range(max(0, -o), min(len(x), len(y) - o))]
                votes = sum((a & 0xFFFF == b & 0xFFFF) + (a >> 16 == b >> 16) for a, b in pairs)
                if votes >= least_votes and len(pairs) >= min(chroma.LEAST_OVERLAP, len(x), len(y)):
                    error = sum((a ^ b).bit_count() for a, b in pairs) / (32 * len(pairs))
                    best = max(best or (0,), (votes, -abs(o), o, error))
            if best and best[3] <= most_error:
                out[r, q] = best[2:]
    return out


@pytest.mark.parametrize("block,at_once", [(1 << 18, 1 << 20), (60, 7)])
def test_alignment_equals_all_offsets_of_all_pairs(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(chroma, "BLOCK_CODES", block)
    monkeypatch.setattr(chroma, "AT_ONCE", at_once)
    rnd = np.random.default_rng(4)
    base = [rnd.integers(0, 1 << 32, n, dtype=np.uint32) for n in (40, 25, 30)]
    base[2][:] = base[2][0]  # one code throughout: every offset gets votes
    prints = {100 * (k + 1): b for k, b in enumerate(base)}
    for k in range(12):
        x = base[k % 3][rnd.integers(0, 8) : rnd.integers(20, 25)].copy()
        x ^= np.where(rnd.random(len(x)) < 0.5, np.uint32(1) << rnd.integers(0, 32, len(x), dtype=np.uint32), np.uint32(0))
        prints[k + 1] = np.concatenate([rnd.integers(0, 1 << 32, rnd.integers(0, 9), dtype=np.uint32), x])
    prints[90], prints[91] = base[0][:1], rnd.integers(0, 1 << 32, 3, dtype=np.uint32)
    rows = spark.createDataFrame([(k, [int(v) for v in c]) for k, c in prints.items()], "id long, codes array<long>")
    want, by_row = plain_matches(prints), {}
    for (r, q), (offset, error) in want.items():
        by_row.setdefault(r, []).append((error, q, offset))
    assert len(want) >= 10
    for g in chroma.aligned(rows).collect():
        own = by_row.get(g.id, [])
        assert g.n_matches == len(own)
        assert (g.best_error, g.best_query, g.best_offset) == (min(own) if own else (None, None, None))


def test_recall_of_noisy_recordings():
    """Of pairs up to the allowed error at no offset, at least 0.9 are found."""
    rnd, pairs = np.random.default_rng(6), []
    for k in range(240):
        v = rnd.normal(0, 1, 64)
        a = chroma.melody(v)
        if k % 3 == 0:
            b = chroma.melody(v + rnd.normal(0, rnd.uniform(0.02, 0.3), 64))
        elif k % 3 == 1:
            b = a + rnd.normal(0, rnd.uniform(0.1, 1.5), len(a))
        else:
            u = v.copy()
            some = rnd.choice(64, rnd.integers(1, 14), replace=False)
            u[some] = rnd.normal(0, 1, len(some))
            b = chroma.melody(u)
        x, y = chroma.codes(chroma.chroma(a)), chroma.codes(chroma.chroma(b))
        if 0 < np.bitwise_count(x ^ y).sum() / (32 * len(x)) <= chroma.MOST_ERROR:
            pairs.append((x, y))
    kind = pa.list_(pa.int64())
    asked = pa.table({"mark": [f"q{k}" for k in range(len(pairs))], "query_id": range(len(pairs)), "codes": pa.array([x.tolist() for x, _ in pairs], kind)})
    rows = pa.table({"mark": [str(k) for k in range(len(pairs))], "codes": pa.array([y.tolist() for _, y in pairs], kind)})
    got = chroma.meet(asked, rows, chroma.LEAST_VOTES, chroma.MOST_ERROR).to_pylist()
    found = {int(g["mark"]) for g in got if int(g["mark"]) == g["query_id"]}
    assert len(pairs) > 100 and len(found) >= 0.9 * len(pairs)
