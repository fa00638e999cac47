"""License scans by a positional index of rare tokens, in DataFrame operations only.

Templates are passages and notices of well-known licences; each lists key phrases that it must hold. How many documents
hold each of their words is counted over the whole corpus. A template is indexed under its RARE words of highest
inverse document frequency, with their places. A file's licence words that are in the index, so the rarest
ones it shares with any template, are looked up: a word at i that a template has at o says that the template begins at i - o.
Such a beginning is held against the template's other postings, each within DRIFT words of its own place; the share of their
weights found is its score. Key phrases are then verified word by word. A base phrase is a template that is its own key phrase:
it is looked up under its rarest word only, and its places are exact.

Defined results: a null text counts as empty; a text without words has n_words 0, no label and score 0; repeated rows are
returned each and count each in the frequencies; a null doc_id is kept; words that no document holds have the highest
frequency weight; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: words, and base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages and notices of licences as their owners publish them, lower case, and key phrases of each.
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache-2.0", "apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["except in compliance with the license", "without warranties or conditions of any kind"]),
    ("gpl-2.0", "gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "gnu general public license version 3", ["general public license version 3"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["under the terms of the gnu general public license", "published by the free software foundation"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms", "retain the above copyright notice"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("boost-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
]
#: Words of a template that index it; how far a word may be from its place; the least share of a match.
RARE, DRIFT, LEAST_SHARE = 6, 3, 0.7
#: Beginnings of one template as whole numbers: more than there are words in a text.
SPREAD = 1 << 33
_FOUND = "array<struct<label:string,start:int,share:double,verified:boolean,base:boolean>>"


def lowered(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def words_of(text: Column) -> Column:
    """Words of the text with A-Z in lower case."""
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def vocabulary() -> list[str]:
    return sorted({w for text in [*PHRASES, *(t for _, t, _ in TEMPLATES)] for w in re.findall(WORD, text)})


def frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each word of the templates (at most a few hundred)."""
    held = docs.select(F.explode(F.array_append(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary()))), F.lit(""))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return counts.get("", 0), counts


def index(documents: int, counts: dict[str, int], rare: int = RARE) -> tuple[list[dict], list[dict]]:
    """(templates, postings): templates with the weights and places of their rarest words, and where each of these leads."""
    templates, postings = [], []
    for k, (label, text, keys) in enumerate([*((label, p, [p]) for p, label in PHRASES.items()), *TEMPLATES]):
        own = re.findall(WORD, text)
        rarest = sorted(set(own), key=lambda w: (counts.get(w, 0), w))[: 1 if k < len(PHRASES) else rare]
        places = {w: [i for i, x in enumerate(own) if x == w] for w in rarest}
        weight = {w: round(math.log((documents + 1) / (counts.get(w, 0) + 1)) + 1e-3, 6) for w in rarest}
        parts = [re.findall(WORD, key) for key in keys]
        at = [next(i for i in range(len(own)) if own[i : i + len(p)] == p) for p in parts]
        templates.append({
            "label": label, "base": k < len(PHRASES), "total": sum(weight.values()),
            "rare": [{"word": w, "weight": weight[w], "places": places[w]} for w in rarest],
            "keys": [{"words": p, "at": a} for p, a in zip(parts, at)],
        })
        postings += [{"word": w, "template": k, "at": i} for w in rarest for i in places[w]]
    return templates, postings


def near(words: Column, at: Column, drift: Column) -> Column:
    """The words from `drift` before to `drift` after the place `at`."""
    low = F.greatest(at - drift, F.lit(0))
    return F.slice(words, low + 1, F.greatest(at + drift - low + 1, F.lit(0)))


def stands(words: Column, part: Column, at: Column) -> Column:
    """True if the words of `part` stand consecutively from `at` on."""
    return (at >= 0) & (F.slice(words, F.greatest(at, F.lit(0)) + 1, F.size(part)) == part)


def matches(words: Column, templates: list[dict], postings: list[dict], hits: Column) -> Column:
    """Every beginning of a template that a looked-up word votes for: label, start, share, verified, base; by label and start."""
    table = F.from_json(
        F.lit(json.dumps(templates)),
        "array<struct<label:string,base:boolean,total:double,rare:array<struct<word:string,weight:double,places:array<int>>>,keys:array<struct<words:array<string>,at:int>>>>",
    )
    posted = F.from_json(F.lit(json.dumps(postings)), "array<struct<word:string,template:int,at:int>>")
    drift = lambda t: F.when(t["base"], 0).otherwise(DRIFT)
    # a vote is one number, of its template and beginning, since arrays of numbers are made distinct by hashing
    votes = F.flatten(
        F.transform(
            hits,
            lambda h: F.transform(F.filter(posted, lambda p: p["word"] == h["word"]), lambda p: p["template"].cast("long") * SPREAD + (h["at"] - p["at"]) + SPREAD // 2),
        )
    )

    def scored(v: Column) -> Column:
        t, start = F.get(table, F.floor(v / SPREAD).cast("int")), (F.pmod(v, F.lit(SPREAD)) - SPREAD // 2).cast("int")
        has = lambda r: F.exists(r["places"], lambda o: F.array_contains(near(words, start + o, drift(t)), r["word"]))
        share = F.aggregate(t["rare"], F.lit(0.0), lambda s, r: s + F.when(has(r), r["weight"]).otherwise(0.0)) / t["total"]
        holds = lambda k: F.exists(F.sequence(-drift(t), drift(t)), lambda j: stands(words, k["words"], start + k["at"] + j))
        return F.struct(
            t["label"].alias("label"), start.alias("start"), F.least(share, F.lit(1.0)).alias("share"), F.forall(t["keys"], holds).alias("verified"), t["base"].alias("base")
        )

    return F.array_sort(F.transform(F.array_distinct(votes), scored))


def license_matches(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, found: each base phrase, in all its places, and each beginning of a template with its share and whether its key phrases hold."""
    templates, postings = index(*frequencies(docs))
    looked_up = sorted({p["word"] for p in postings})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    at = F.transform("words", lambda w, i: F.when(w.isin(looked_up), F.struct(i.alias("at"), w.alias("word"))))
    rows = rows.select("doc_id", "words", F.filter(at, lambda h: h.isNotNull()).alias("hits"))
    found = matches(F.col("words"), templates, postings, F.col("hits"))
    none = F.array().cast(_FOUND)
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.size("hits") > 0, found).otherwise(none).alias("found"))


def labelled(found: Column) -> Column:
    """What counts as a match: key phrases hold, and enough of the rare words stand in place."""
    return F.filter(found, lambda f: f["verified"] & (f["base"] | (f["share"] >= LEAST_SHARE)))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document.

    score, to 6 decimals, is the largest share of a match; of beginnings that are none it counts by half.
    """
    rows = license_matches(docs).withColumn("match", labelled(F.col("found")))
    base = F.filter("match", lambda f: f["base"])
    names = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda f: f["label"]))), ",")
    starts = F.transform(base, lambda f: f["start"].cast("long"))
    best = lambda m: F.coalesce(F.array_max(F.transform(m, lambda f: f["share"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("match")).alias("labels"), F.round(F.greatest(best(F.col("match")), best(F.col("found")) / 2), 6).alias("score"),
    )
