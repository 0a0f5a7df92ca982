"""Toxicity by class-conditional Kneser-Ney models with a shared backoff.

Texts are sequences of units: a word that occurs twice in the learned rows, else its longest such prefix (so that words
met once give prefixes their counts), else one unit for the rest. Each class has bigram counts that back off, with
absolute discounting, to the class's continuation counts (distinct predecessors of a unit) and from there to
continuation counts that both classes share; the shared ones are taken over all documents. Rare units and rare bigrams
lean further on what they back off to, in log space, and each conditional distribution is then normalised to sum to one.
How far they lean is chosen among LEANS by folds of learned rows that the counts have not seen, never by others. A unit's
evidence is its log-likelihood in the toxic model less that in the ordinary one. A text's length-normalised evidence,
and that of its most toxic units, give its score by a logistic curve fit on those same unseen rows.

Null and empty texts have no evidence and get the curve's value at zero; if no toxic row can be learned from, all
scores are 0. Labels other than 0 and 1 are none; of several labels of a doc_id the largest holds. Repeated rows each
give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import CLEANUP, fold, slices, text_of, tidy

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows to learn from, about; least occurrences of a unit; shortest prefix.
TRAIN_ROWS, LEAST_COUNT, SHORTEST = 16_000, 2, 4
LONGEST_PREFIX = 12
#: Distinct pairs that a task holds before it hands them on.
PAIRS_HELD = 4_000_000
DISCOUNT = 0.75
#: Occurrences at which a unit's or bigram's own counts weigh as much as what it backs off to: what is tried.
LEANS = (2.0, 8.0, 32.0)
#: So many of a text's most toxic expressions are looked at; evidence that counts as strong.
TOP, STRONG = (1, 3, 8), 2.0
CACHE_ENTRIES = 400_000
#: Bigrams that the driver looks at together, about: all that follow a unit are.
TOGETHER = 1 << 18


def _plain(code: int) -> int:
    """The lower-case letter that a Latin-1 sign stands for, or a blank."""
    low = chr(code).lower()
    return ord(low) if len(low) == 1 and ord(low) < 256 and WORD.fullmatch(low) else 32


PLAIN = bytes(map(_plain, range(256)))


def _split(text: str) -> str:
    """The lower-case words of a text, with blanks between them; a Latin-1 text goes through a table, with the same result as the pattern's."""
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        return " ".join(WORD.findall(text.lower()))
    return plain.translate(PLAIN).decode("latin-1")


def words_of(text: str) -> list[str]:
    return _split(text).split()


class Units:
    """Maps words to unit numbers; 0 is the rest. Prefixes are keyed with a star behind them."""

    def __init__(self, names: list[str]):
        self.ids = {x: k + 1 for k, x in enumerate(names)}
        self.cache: dict[str, int] = {}

    def _find(self, word: str) -> int:
        found = self.ids.get(word)
        if found is not None:
            return found
        # A prefix of a known prefix is known too: its count is no less.
        found, low, high = 0, SHORTEST, min(len(word) - 1, LONGEST_PREFIX)
        while low <= high:
            n = (low + high) // 2
            here = self.ids.get(f"{word[:n]}*")
            if here is None:
                high = n - 1
            else:
                found, low = here, n + 1
        return found

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts, and how many each text has; each distinct word is looked up once."""
        lists = pa.compute.ascii_split_whitespace(pa.array(map(_split, texts), pa.large_string()))
        owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
        coded = lists.flatten().dictionary_encode()
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        words = coded.dictionary.to_pylist()
        for w in set(words).difference(self.cache):
            self.cache[w] = self._find(w)
        known = np.fromiter(map(self.cache.__getitem__, words), dtype=np.int64, count=len(words))
        at = np.asarray(coded.indices)
        if "" in self.cache:  # before a first and behind a last word
            inside = np.array([w != "" for w in words], dtype=bool)[at]
            at, owner = at[inside], owner[inside]
        return known[at], np.bincount(owner, minlength=len(texts))

    def bigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The bigrams of all texts, and how many each text has; 0 is before a text's first unit."""
        units, counts = self.texts(texts)
        before = np.append(0, units[:-1])[: len(units)]
        before[(np.cumsum(counts) - counts)[counts > 0]] = 0
        return before * (len(self.ids) + 1) + units, counts


@dataclass
class ToxicityModel:
    names: list[str] = field(default_factory=list)
    #: Evidence of a unit by the backoff alone; what a preceding unit adds to it; evidence of known bigrams by key.
    unit: np.ndarray = field(default_factory=lambda: np.zeros(1))
    after: np.ndarray = field(default_factory=lambda: np.zeros(1))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    bigram: np.ndarray = field(default_factory=lambda: np.zeros(0))
    curve: np.ndarray | None = None

    def features(self, bigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """By text: length-normalised evidence, that of the most toxic expressions, how many are strong, and log length."""
        out = np.zeros((len(counts), 3 + len(TOP)))
        if not len(bigrams):
            return out
        size, rows = len(self.names) + 1, len(counts)
        # The same expression again and again is evidence once at the top; all of a text's expressions lie together.
        order = np.sort(np.repeat(np.arange(rows), counts) * size**2 + bigrams) if rows * float(size) ** 2 < 2.0**63 else None
        if order is None:
            parts = [self.features(b, np.array([len(b)])) for b in np.split(bigrams, np.cumsum(counts)[:-1])]
            return np.concatenate(parts)
        first = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
        times = np.diff(np.append(first, len(order)))
        owner, key = np.divmod(order[first], size**2)
        evidence = self.unit[key % size] + self.after[key // size]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            evidence = np.where(self.keys[at] == key, self.bigram[at], evidence)
        out[:, 0] = np.bincount(owner, weights=evidence * times, minlength=rows) / np.maximum(counts, 1)
        out[:, -2] = np.minimum(np.bincount(owner, weights=evidence > STRONG, minlength=rows), TOP[-1])
        out[:, -1] = np.log1p(counts)
        toxic = np.flatnonzero(evidence > 0)
        toxic = toxic[np.lexsort((-evidence[toxic], owner[toxic]))]
        place = np.arange(len(toxic)) - np.searchsorted(owner[toxic], owner[toxic])
        for k, most in enumerate(TOP):
            own = toxic[place < most]
            out[:, 1 + k] = np.bincount(owner[own], weights=evidence[own], minlength=rows) / most
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + features @ self.curve[1:], -30, 30)))


def _counted(frame: DataFrame, count, schema: str) -> DataFrame:
    """Counts of keys, first within partitions, then over all."""
    keys = [c.split()[0] for c in schema.split(", ")][:-1]
    return frame.mapInArrow(count, schema).groupBy(*keys).agg(F.sum("n").alias("n"))


def _frequent_units(rows: DataFrame) -> list[str]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in slices(batches):
            for text in text_of(batch):
                words.update(words_of(text))
        units: Counter = Counter()
        for w, n in words.items():
            units[w] += n
            for k in range(SHORTEST, min(len(w) - 1, LONGEST_PREFIX) + 1):
                units[f"{w[:k]}*"] += n
        names = list(units)
        for k in range(0, len(names), 50_000):
            own = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([units[x] for x in own], pa.int64())], ["unit", "n"])

    kept = _counted(rows.select("text"), count, "unit string, n long").where(F.col("n") >= LEAST_COUNT)
    return sorted(kept.select("unit").toArrow().column("unit").to_pylist())  # of the bounded sample


def _pair_counter(names: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(names)
        seen: dict[int, Counter] = {}
        for batch in slices(batches):
            keys, counts = units.bigrams(text_of(batch))
            for label, own in zip(batch.column("label").to_pylist(), np.split(keys, np.cumsum(counts)[:-1]), strict=True):
                # Once per text: a text that repeats itself is one witness.
                seen.setdefault(label, Counter()).update(_distinct(own).tolist())
        for label, pairs in seen.items():
            keys = list(pairs)
            for k in range(0, len(keys), 50_000):
                own = keys[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(own), pa.int32()), pa.array(own, pa.int64()), pa.array([pairs[x] for x in own], pa.int64())], ["label", "pair", "n"])

    return count


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; a plain sort of integers is many times faster than a hash table of them."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _corpus_continuations(docs: DataFrame, names: list[str]) -> np.ndarray:
    """Distinct predecessors of each unit in all documents, and one."""
    shared, size = docs.sparkSession.sparkContext.broadcast(names), len(names) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, held = Units(shared.value), []
        for batch in slices(batches):
            # Slices are made distinct by themselves first, so that what is held is seldom sorted again.
            held.append(_distinct(units.bigrams(text_of(batch))[0]))
            if sum(map(len, held)) > PAIRS_HELD:
                held = [_distinct(np.concatenate(held))]
                if len(held[0]) > PAIRS_HELD // 2:
                    yield from _batches(held.pop())
        if held:
            yield from _batches(_distinct(np.concatenate(held)))

    pairs = docs.select("text").mapInArrow(count, "pair long").distinct()
    found = pairs.groupBy((F.col("pair") % size).alias("unit")).agg(F.count("*").alias("n")).toArrow()  # a row for each unit at most
    shared.destroy()
    out = np.ones(size)
    out[np.asarray(found.column("unit"))] += np.asarray(found.column("n"))
    return out


def _batches(pairs: np.ndarray, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(pairs), rows):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + rows])], ["pair"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + ridge * np.append(0, w[1:])
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return w


def fit_toxicity(labelled: DataFrame, docs: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """labelled: doc_id, text and label (1: toxic) of the rows to learn from; docs: all texts, for the shared counts."""
    labelled = labelled.where(F.col("label").isNotNull()).select("doc_id", "text", F.col("label").cast("int").alias("label"))
    total = labelled.count()
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1 << 30))
    sample = labelled if total <= train_rows else labelled.where(part < int((1 << 30) * train_rows / total))
    sample = sample.dropDuplicates(["text", "label"])  # so are copies of a text
    for_curve = F.pmod(F.xxhash64("text", F.lit(2)), F.lit(3)) == 0
    counted, rest = sample.where(~for_curve), sample.where(for_curve)
    names = _frequent_units(counted)
    size = len(names) + 1
    pairs = _counted(counted.select("label", "text"), _pair_counter(names), "label int, pair long, n long")
    # All pairs of the bounded sample.
    found = pairs.select(F.col("label").cast("tinyint").alias("label"), "pair", F.col("n").cast("int").alias("n")).toArrow()
    label, pair, n = (found.column(c).to_numpy() for c in ("label", "pair", "n"))
    del found
    tidy()
    continued, before = np.zeros((2, size)), np.zeros((2, size))
    for a in range(0, len(pair), TOGETHER):
        own = slice(a, a + TOGETHER)
        np.add.at(continued, (label[own], pair[own] % size), 1)
        np.add.at(before, (label[own], pair[own] // size), n[own])
    if not before[1].sum() or not before[0].sum():
        return ToxicityModel(names)
    shared = _corpus_continuations(docs, names)
    table = Counts(names, label, pair, n, continued, before, shared / shared.sum())
    del label, pair, n
    best = None
    for lean in LEANS:
        tidy()
        tried = table.model(lean)
        scored, sent = _features(rest.select("label", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(2)).cast("int").alias("half"), "text"), tried, ["label", "half"])
        rows = scored.collect()  # a third of the bounded sample
        sent.destroy()  # its copies lie on every executor's disk
        x, y, half = np.array([r.features for r in rows]).reshape(len(rows), -1), np.array([r.label for r in rows], dtype=float), np.array([r.half for r in rows], dtype=int)
        if len(set(y)) < 2:
            return tried
        loss = _crossed(x, y, half)
        if best is None or loss < best[0]:
            best = (loss, lean, _logistic(x, y))
        del tried
    model = table.model(best[1])
    model.curve = best[2]
    return model


def _crossed(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> float:
    """Log loss of each half under the curve of the other one."""
    loss = 0.0
    for k in (0, 1):
        own, other = half == k, half != k
        if own.any() and len(set(y[other])) == 2:
            w = _logistic(x[other], y[other])
            p = np.clip(1 / (1 + np.exp(-np.clip(w[0] + x[own] @ w[1:], -30, 30))), 1e-6, 1 - 1e-6)
            loss -= float((y[own] * np.log(p) + (1 - y[own]) * np.log(1 - p)).sum())
    return loss


@dataclass
class Counts:
    """What the classes' models are made from: bigrams by class, and continuation counts of the classes and of all documents.

    Bigrams are held in their order and looked at TOGETHER at a time, so that only the counts themselves are held for all of them.
    """

    names: list[str]
    label: np.ndarray
    pair: np.ndarray
    n: np.ndarray
    continued: np.ndarray
    before: np.ndarray
    shared: np.ndarray

    def __post_init__(self) -> None:
        if (self.pair[1:] < self.pair[:-1]).any():
            order = np.argsort(self.pair, kind="stable")
            self.label, self.pair, self.n = self.label[order], self.pair[order], self.n[order]
        #: Each bigram once.
        self.keys = self.pair[np.append(True, self.pair[1:] != self.pair[:-1])[: len(self.pair)]]

    def _parts(self, together: int) -> Iterator[slice]:
        """Stretches of about so many bigrams; those behind one predecessor are in one."""
        size, a = len(self.names) + 1, 0
        while a < len(self.pair):
            last = min(a + together, len(self.pair)) - 1
            b = int(np.searchsorted(self.pair, (self.pair[last] // size + 1) * size))
            yield slice(a, b)
            a = b

    def backoff(self, lean: float) -> np.ndarray:
        """By class, each unit's probability from distinct predecessors; what discounts leave goes to the shared counts, on which rare units lean."""
        less = np.maximum(self.continued - DISCOUNT, 0)
        total = self.continued.sum(axis=1)[:, None]
        own = (less + (total - less.sum(axis=1)[:, None]) * self.shared) / total
        size = len(self.names) + 1
        seen = np.zeros(size)
        for part in self._parts(TOGETHER):
            np.add.at(seen, self.pair[part] % size, self.n[part])
        sure = seen / (seen + lean)
        unit = sure * own + (1 - sure) * self.shared
        return unit / unit.sum(axis=1)[:, None]

    def _part(self, part: slice, unit: np.ndarray, left: np.ndarray, lean: float) -> np.ndarray:
        """Probabilities by class of a stretch's bigrams; what is left behind its predecessors is written to left."""
        size = len(self.names) + 1
        label, n = self.label[part], self.n[part]
        keys, at = np.unique(self.pair[part], return_inverse=True)
        w = keys % size
        first, v = np.unique(keys // size, return_inverse=True)
        own, rest = np.zeros((2, len(keys))), np.ones((2, len(first)))
        share = (n - DISCOUNT) / self.before[label, first[v[at]]]
        own[label, at] = share
        np.subtract.at(rest, (label, v[at]), share)
        rest = np.maximum(rest, 1e-6)
        own += rest[:, v] * unit[:, w]
        # Rare predecessors and rare bigrams lean on the backoff.
        seen, witnesses = self.before[:, first].sum(axis=0), np.bincount(at, weights=n, minlength=len(keys))
        rest **= seen / (seen + lean)
        sure = witnesses / (witnesses + lean)
        p = own**sure * (rest[:, v] * unit[:, w]) ** (1 - sure)
        for c in (0, 1):
            known = np.bincount(v, weights=p[c], minlength=len(first))
            whole = known + rest[c] * (1 - np.bincount(v, weights=unit[c, w], minlength=len(first)))
            p[c] /= whole[v]
            rest[c] /= whole
        left[:, first] = rest
        return p

    def distributions(self, lean: float, together: int = TOGETHER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Known bigrams (keys), their probabilities by class, and by class and predecessor what is left for the backoff; the backoff."""
        unit, left = self.backoff(lean), np.ones((2, len(self.names) + 1))
        p = [self._part(part, unit, left, lean) for part in self._parts(together)]
        return self.keys, np.concatenate(p, axis=1), left, unit

    def model(self, lean: float, together: int = TOGETHER) -> ToxicityModel:
        unit, left = self.backoff(lean), np.ones((2, len(self.names) + 1))
        bigram, done = np.empty(len(self.keys), dtype=np.float32), 0
        for part in self._parts(together):
            p = self._part(part, unit, left, lean)
            bigram[done : done + p.shape[1]] = np.log(p[1] / p[0])
            done += p.shape[1]
        return ToxicityModel(self.names, np.log(unit[1] / unit[0]), np.log(left[1] / left[0]), self.keys, bigram)


def _features(rows: DataFrame, model: ToxicityModel, keep: list[str]) -> tuple[DataFrame, Broadcast]:
    """keep and features of each row, and the broadcast model that they are read from."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(shared.value.names)
        for batch in slices(batches):
            found = shared.value.features(*units.bigrams(text_of(batch)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found.tolist(), pa.list_(pa.float64()))], [*keep, "features"])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(step, f"{kept}, features array<double>"), shared


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; labels of held-out rows are not looked at."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    out = fold("doc_id", folds) == held_out
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(~out & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    conf = docs.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")  # each step of the fit reads its shuffle files once
    try:
        model = fit_toxicity(docs.where(~out).join(known, "doc_id"), docs)
    finally:
        conf.set(CLEANUP, before)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(shared.value.names)
        for batch in slices(batches):
            scores = shared.value.scores(shared.value.features(*units.bigrams(text_of(batch))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", out.alias("held_out"), "text").mapInArrow(step, "doc_id long, held_out boolean, score double, predicted int")
