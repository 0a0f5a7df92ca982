"""License scans: an index of the rarest words of licence texts with their places, in DataFrame functions only.

Templates are short texts that licences are known by; base phrases are templates of which every word counts. A word's
rarity is taken from how many of all documents hold it. Each template is indexed by its RARE rarest words and their
places in it. A document's words are looked up there; every hit says where the template would start, and starts on
which enough of its words agree are candidates. A candidate stands if its mandatory key phrase is there word by word
and if its words in place make up SHARE of the template by inverse document frequency (base phrases: all of it).

The look-up is done within each document's row: no text is shuffled, and a source or a text that makes up a third of
all rows is no hot key. The first pass over the documents counts licence words; its result has as many rows as the
templates have words, at most, and is the only thing that is collected.

Null texts count as empty: no words, no labels, first_word and last_word null, score 0. Repeated rows each give a row,
null doc_ids too; columns other than doc_id and text are ignored; an empty table gives none. Words are held as an
array per text: some 60 bytes for each word of a very long one.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.decontam import words

RARE, AGREE, SHARE = 3, 2, 0.6

#: Phrases that are labels by themselves.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Label, text, and the key phrase without which it is none of that licence.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted free of charge"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "public domain"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", "commons attribution 4"),
    ("proprietary", "confidential and proprietary all rights reserved", "confidential and proprietary"),
]


def templates() -> list[dict]:
    """label, base, words, and key (first place, number of words), base phrases first."""
    out = [{"label": label, "base": True, "words": text.split(), "key": (0, len(text.split()))} for label, text in BASE]
    for label, text, key in TEMPLATES:
        w, k = text.split(), key.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        out.append({"label": label, "base": False, "words": w, "key": (at, len(k))})
    return out


def frequencies(texts: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """How many rows there are, and how many of them hold each word of the vocabulary. texts: w, an array of words."""
    own = F.array_distinct(F.filter("w", lambda x: x.isin(*sorted(vocabulary))))
    counted = texts.select(F.explode(F.array_append(own, F.lit(""))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r.word: r.n for r in counted.collect()}  # no more rows than the vocabulary has words
    return found.pop("", 0), found


def _places(word: str, place: int) -> Column:
    """Where the template would start, from each hit of one of its words."""
    return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"] - F.lit(place))


def _starts(rare: list[tuple[str, int]], every: bool) -> Column:
    """Starts on which all of the rare words agree, or AGREE of them: intersections by hash, in proportion to the hits."""
    at = [_places(x, place) for x, place in rare]
    if every:
        starts = at[0]
        for other in at[1:]:
            starts = F.array_intersect(starts, other)
        return F.array_distinct(starts)
    both = [F.array_intersect(a, b) for a, b in combinations(at, AGREE)]
    return F.array_distinct(F.concat(*both)) if both else at[0]


def _found(template: dict, rare: list[tuple[str, int]], idf: list[float]) -> Column:
    """label, base, start and share of each candidate that stands."""
    w, (first, size) = template["words"], template["key"]
    key = F.array(*(F.lit(x) for x in w[first : first + size]))

    def share(s: Column) -> Column:
        own = [F.when(F.get("w", s + i) == x, F.lit(v)).otherwise(F.lit(0.0)) for i, (x, v) in enumerate(zip(w, idf, strict=True))]
        return sum(own[1:], own[0]) / F.lit(sum(idf))

    def one(s: Column) -> Column:
        return F.struct(F.lit(template["label"]).alias("label"), F.lit(template["base"]).alias("base"), s.cast("long").alias("start"), (F.lit(1.0) if template["base"] else share(s)).alias("share"))

    stands = F.filter(_starts(rare, template["base"]), lambda s: (s + first >= 0) & (F.slice("w", F.greatest(s + first, F.lit(0)) + 1, F.lit(size)) == key))
    return F.filter(F.transform(stands, one), lambda x: x["share"] >= SHARE)


def scan(docs: DataFrame, known: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words and found: an array of (label, base, start, share) for each template and place where it stands."""
    known = templates() if known is None else known
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words("text").alias("w"))
    rows, held = frequencies(texts, {w for t in known for w in t["words"]})
    looked_up, found = set(), []
    for t in known:
        w, (first, size) = t["words"], t["key"]
        if not all(held.get(x) for x in w[first : first + size]):
            continue  # a word it can't do without is in no document
        # The rarest words that any document holds, at their first places; ties by place.
        rare = sorted(((x, w.index(x)) for x in held.keys() & set(w)), key=lambda x: (held[x[0]], x[1]))
        rare = rare if t["base"] else rare[:RARE]
        looked_up |= {x for x, _ in rare}
        found.append(_found(t, rare, [math.log((1 + rows) / (1 + held.get(x, 0))) + 1 for x in w]))
    kind = "array<struct<label:string,base:boolean,start:bigint,share:double>>"
    none = F.expr(f"cast(array() as {kind})")
    if not found:
        return texts.select("doc_id", F.size("w").cast("long").alias("n_words"), none.alias("found"))
    hit = F.transform("w", lambda x, i: F.when(x.isin(*sorted(looked_up)), F.struct(x.alias("word"), i.alias("at"))))
    hits = texts.select("doc_id", "w", F.filter(hit, lambda x: x.isNotNull()).alias("hits"))
    every = F.when(F.size("hits") > 0, F.concat(*(f.cast(kind) for f in found))).otherwise(none)
    return hits.select("doc_id", F.size("w").cast("long").alias("n_words"), every.alias("found"))


def labelled(docs: DataFrame, known: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (the largest share in place)."""
    base = F.filter("found", lambda x: x["base"])
    names = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["label"]))), ",")
    start = F.transform("base", lambda x: x["start"])
    rows = scan(docs, known).select("doc_id", "n_words", "found", base.alias("base"))
    score = F.round(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)), 6)
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        names(F.col("base")).alias("base_labels"), names(F.col("found")).alias("labels"), F.least(score, F.lit(1.0)).alias("score"),
    )
