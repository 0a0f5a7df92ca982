"""Language identification by words first, then ever shorter character n-grams.

A model holds, per language, relative frequencies of words and of character n-grams. A word that the model knows
scores by its log frequency in each language (a fixed penalty where a language lacks it); an unseen word scores by
the mean over its longest n-grams of which any is known, backing off from MAX_ORDER to single characters. A text's
score is the mean over its words. Models are fit on bounded samples of labelled rows, the same bounds for each
language, so that a frequent one takes nothing from the others; so models may be broadcast.

Null texts and texts without letters give "und" with score 0; so does every text if nothing could be learned. Ties
go to the alphabetically first language. Repeated rows each give a row, but a text is learned from once in a language;
whatever the doc_ids are, null or shared, samples are drawn by text. An empty table gives an empty result. Every
language with an entry that its labelled texts hold twice is learned, however many there are. A very long text takes memory in proportion to
its words, not to words times languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.llm.common import fold, materialize, slices, text_of

MAX_ORDER = 5
UNKNOWN = "und"
#: For each language: about so many labelled texts are learned from, and so many entries kept; the least count of an entry.
TRAIN_ROWS, LANGUAGE_ENTRIES, LEAST_COUNT = 4_000, 50_000, 2
#: Entries of a whole model: of more languages than fit, each keeps equally fewer entries, and none is left out.
MODEL_ENTRIES = 4_000_000
#: Up to so many languages their sizes are broadcast.
BROADCAST_LANGUAGES = 100_000
#: Evidence of at most so many words goes into the score, so that it stays a usable confidence.
SCORE_WORDS = 20
#: Words remembered at most; weights remembered, and weights looked at together.
CACHE_ENTRIES, CACHE_WEIGHTS, AT_ONCE = 300_000, 1 << 24, 1 << 20
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. Superscripts, circled digits and other number signs are no letters."""
    found = WORD.findall(text.lower())
    if found and not "".join(found).isalpha():
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found


def grams(word: str, order: int) -> list[str]:
    if order == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


@dataclass
class LanguageModel:
    """languages, sorted; places: by order, words at 0, the row of each entry; then each row's languages and log10 frequencies."""

    languages: list[str]
    places: list[dict[str, int]]
    ends: np.ndarray
    among: np.ndarray
    weights: np.ndarray
    penalty: float = -7.0

    def row(self, k: int) -> np.ndarray:
        """A weight for each language."""
        out = np.full(len(self.languages), self.penalty)
        own = slice(self.ends[k], self.ends[k + 1])
        out[self.among[own]] = self.weights[own]
        return out


class Scorer:
    """Applies a model; remembers the scores of words between batches."""

    def __init__(self, model: LanguageModel):
        self.model, self.index, self.entries = model, {}, {}
        n = max(len(model.languages), 1)
        self.together = min(CACHE_ENTRIES, max(1, AT_ONCE // n))
        self.most = min(CACHE_ENTRIES, max(self.together, CACHE_WEIGHTS // n))
        self.rows = np.zeros((min(self.most, 1024), n))

    def _entry(self, k: int) -> np.ndarray:
        found = self.entries.get(k)
        if found is None:
            if len(self.entries) >= max(1, self.most // 4):
                self.entries.clear()
            found = self.entries[k] = self.model.row(k)
        return found

    def word(self, word: str) -> np.ndarray:
        places = self.model.places
        known = places[0].get(word)
        if known is not None:
            return self.model.row(known)
        for order in range(min(MAX_ORDER, len(word) + 2), 0, -1):
            found = [k for g in grams(word, order) if (k := places[order].get(g)) is not None]
            if found:
                return sum(map(self._entry, found)) / len(found)
        return np.full(len(self.model.languages), self.model.penalty)

    def _add(self, words: list[str]) -> None:
        for w in words:
            k = self.index.setdefault(w, len(self.index))
            if k >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[k] = self.word(w)

    def _summed(self, words: list[str]) -> np.ndarray:
        """The sum of the words' weights."""
        try:
            at = list(map(self.index.__getitem__, words))
        except KeyError:
            fresh = set(words).difference(self.index)
            if len(self.index) + len(fresh) > self.most:
                self.index.clear()
                fresh = set(words)
            self._add(sorted(fresh))
            at = list(map(self.index.__getitem__, words))
        return self.rows[at].sum(axis=0)

    def text(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        # A long text goes through in parts, so that its weights are never held for all words and languages.
        mean = sum(self._summed(words[a : a + self.together]) for a in range(0, len(words), self.together)) / len(words)
        best = int(np.argmax(mean))
        odds = np.exp((mean - mean[best]) * np.log(10) * min(len(words), SCORE_WORDS))
        return self.model.languages[best], float(1 / odds.sum())


def fit_language_model(docs: DataFrame, train_rows: int = TRAIN_ROWS, entries: int = LANGUAGE_ENTRIES) -> LanguageModel:
    """Learn from about train_rows texts of each language among docs' rows, and keep so many entries of each."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    sizes = materialize(sizes, "sizes")
    many = sizes.count()
    entries = max(1, min(entries, MODEL_ENTRIES // max(many, 1)))
    sizes = F.broadcast(sizes) if many <= BROADCAST_LANGUAGES else sizes
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    sample = labelled.join(sizes, "lang").where(part * F.col("rows") < (1 << 30) * train_rows).select("lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), text_of(batch), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in seen.items():
            entries: Counter = Counter()
            for w, n in words.items():
                entries[0, w] += n
                for order in range(1, MAX_ORDER + 1):
                    for g in grams(w, order):
                        entries[order, g] += n
            keys = list(entries)
            for k in range(0, len(keys), 50_000):
                own = keys[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([k for k, _ in own], pa.int32()), pa.array([x for _, x in own]), pa.array([entries[x] for x in own], pa.int64())], ["lang", "order", "entry", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, order int, entry string, n long").groupBy("lang", "order", "entry").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "order", "entry"))
    kept = counts.where(F.col("n") >= LEAST_COUNT).withColumn("rank", rank).where(F.col("rank") <= entries).orderBy("order", "entry", "lang")
    # Bounded by languages times entries.
    lang, order, entry, n = _columns(kept)
    languages = sorted(set(lang))
    number = {x: k for k, x in enumerate(languages)}
    among, n = np.array([number[x] for x in lang], dtype=np.int32), np.array(n, dtype=float)
    # Words, and the n-grams of each order, are frequencies of their own.
    totals = np.ones((len(languages), MAX_ORDER + 1))
    np.add.at(totals, (among, order), n)
    places: list[dict[str, int]] = [{} for _ in range(MAX_ORDER + 1)]
    ends = []
    for k, (o, x) in enumerate(zip(order, entry, strict=True)):
        if x not in places[o]:
            places[o][x] = len(ends)
            ends.append(k)
    return LanguageModel(languages, places, np.array([*ends, len(lang)]), among, np.log10(n / totals[among, order]).astype(np.float32))


def _columns(kept: DataFrame) -> list[list]:
    found = kept.select("lang", "order", "entry", "n").toArrow()
    return [found.column(k).to_pylist() for k in range(4)]


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs; nothing but the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            found = [scorer.text(t) for t in text_of(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, "text").mapInArrow(step, f"{schema}, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Fit on the folds that are not held out, predict all rows: doc_id, held_out, lang_pred, score."""
    out = fold("doc_id", folds) == held_out
    model = fit_language_model(docs.where(~out))
    asked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), out.alias("held_out"), "text")
    return predict_language(asked, model)


def recognised(docs: DataFrame, least_score: float = 0.35) -> DataFrame:
    """The rows of docs, with all their columns, whose language is recognised with at least least_score."""
    model = fit_language_model(docs.where(fold("doc_id", 4) != 2))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    names = docs.columns
    inner = [f"c{k}" for k in range(len(names))]  # names may hold dots, or be those of this function
    at = inner[names.index("text")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, at):
            found = [scorer.text(t) for t in text_of(batch, at)]
            yield batch.filter(pa.array([x != UNKNOWN and s >= least_score for x, s in found], pa.bool_()))

    asked = docs.select(*(F.col(f"`{c}`").alias(i) for i, c in zip(inner, names, strict=True)))
    return asked.mapInArrow(step, asked.schema).toDF(*names)
