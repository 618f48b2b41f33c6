"""Licence scan: a positional index of the rarest words of licence notices. SQL functions only.

A template is a notice, as words, with the positions that are mandatory: those of its key phrases.
How many documents hold each mandatory word is counted over all of them; the rarest ``RARE`` places of a
template, those of highest inverse document frequency, are its postings. A file looks up its words in that index.
A word at position p of the file that stands at position o of a template proposes the template at p - o;
what all postings of a template propose alike is a candidate. A candidate is a place of the template if
every mandatory word stands where it should. Its score is the share of the template's words that do. No
true place is lost: its mandatory words are all there, and so are the postings, which are some of them.

Nothing is shuffled but the few counts, and nothing leaves the JVM; a plan's size depends on the templates alone.
Null and empty texts have no words and no places; repeated rows come out once each and count as often; an
empty table gives no rows, and an index that ranks words by the alphabet, as ties are ranked. Texts are taken
whole: one takes some 15 times its size, as an array of words. Columns whose names the results take are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE = 2

# Label, words of the notice, its key phrases. The first three are the base.
TEMPLATES = [
    ("mit", "mit license", ["mit license"]),
    ("apache", "apache license", ["apache license"]),
    ("gpl", "general public license", ["general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software you can redistribute it", "gnu general public license"]),
    ("gpl-2.0", "gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "gnu general public license version 3", ["general public license version 3"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "are permitted provided"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "for any purpose with or without fee"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
BASE = 3


@dataclass(frozen=True)
class Template:
    """``must``: the positions of the key phrases' words, ascending."""

    label: str
    words: tuple[str, ...]
    must: tuple[int, ...]
    base: bool


@dataclass(frozen=True)
class Index:
    """postings: for each rank of rarity, a (word, position) of every template."""

    templates: list[Template]
    postings: list[list[tuple[str, int]]]


def templates(rows: list[tuple[str, str, list[str]]] = TEMPLATES, base: int = BASE) -> list[Template]:
    """A key phrase that the notice does not hold, or fewer than ``RARE`` mandatory words, is an error."""
    out = []
    for k, (label, notice, phrases) in enumerate(rows):
        words, must = notice.split(), set()
        for phrase in map(str.split, phrases):
            at = next((i for i in range(len(words)) if words[i : i + len(phrase)] == phrase), None)
            if at is None:
                raise ValueError(f"{' '.join(phrase)!r} is not in the notice of {label}")
            must.update(range(at, at + len(phrase)))
        if len(must) < RARE:
            raise ValueError(f"the key phrases of {label} have fewer than {RARE} words")
        out.append(Template(label, tuple(words), tuple(sorted(must)), k < base))
    return out


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def index(docs: DataFrame, known: list[Template] | None = None) -> Index:
    """The rarest mandatory words of each template, by the number of documents that hold them."""
    known = templates() if known is None else known
    vocabulary = sorted({t.words[i] for t in known for i in t.must})
    held = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary)))
    counted = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()  # a row for each word of the templates at most
    n = {r.word: r["count"] for r in counted}
    ranked = [sorted((n.get(t.words[i], 0), t.words[i], i) for i in t.must) for t in known]
    return Index(known, [[(r[k][1], r[k][2]) for r in ranked] for k in range(RARE)])


def _array(values: list, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def scan(docs: DataFrame, ix: Index) -> DataFrame:
    """docs with n_words and places: label, first (position of the first mandatory word), score and base of each place of a template, by position and template."""
    w, hits, found = fresh(docs, "words", "hits", "candidates")
    count, reach = len(ix.templates), max(len(t.words) for t in ix.templates)
    rare = sorted({word for rank in ix.postings for word, _ in rank})
    table = F.array(*(F.struct(F.lit(t.label).alias("label"), _array(t.words, "string").alias("words"), _array(t.must, "int").alias("must"), F.lit(t.base).alias("base")) for t in ix.templates))
    every = F.transform(F.col(w), lambda x, i: F.when(x.isin(rare), F.struct(i.cast("bigint").alias("at"), x.alias("word"))))
    rows = docs.withColumn(w, words_of(F.col("text"))).withColumn(hits, F.filter(every, lambda h: h.isNotNull()))

    def proposed(rank: list[tuple[str, int]]) -> Column:
        """A template and its start, as one number, for each hit and posting of one rank."""
        known = F.array(*(F.struct(F.lit(word).alias("word"), F.lit((reach - at) * count + k).cast("bigint").alias("code")) for k, (word, at) in enumerate(rank)))
        return F.flatten(F.transform(F.col(hits), lambda h: F.transform(F.filter(known, lambda p: p["word"] == h["word"]), lambda p: h["at"] * count + p["code"])))

    alike = proposed(ix.postings[0])
    for rank in ix.postings[1:]:
        alike = F.array_intersect(alike, proposed(rank))
    rows = rows.withColumn(found, F.array_sort(alike))

    def place(code: Column) -> Column:
        start, t = F.floor(code / count) - reach, F.get(table, (code % count).cast("int"))
        at = lambda i: F.get(F.col(w), (start + i).cast("int"))
        there = F.forall(t["must"], lambda i: F.coalesce(at(i) == F.get(t["words"], i), F.lit(False)))
        share = F.size(F.filter(t["words"], lambda v, i: at(i) == v)) / F.size(t["words"])
        return F.when(there, F.struct(t["label"].alias("label"), (start + F.get(t["must"], F.lit(0))).alias("first"), share.alias("score"), t["base"].alias("base")))

    places = F.filter(F.transform(F.col(found), place), lambda x: x.isNotNull())
    return rows.withColumns({"n_words": F.size(w).cast("bigint"), "places": places}).drop(w, hits, found)
