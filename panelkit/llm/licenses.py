"""License scans by a positional rare-token index (operator 1).

1. A first pass counts in how many documents each word of the license templates stands. Words that over `common` of all
   documents hold, and over FEW documents, are stop words; the others have an IDF, and the rarer a word, the more it says.
2. A second pass reduces each text to its word count, the places of base phrases, and its hits: indexed words with their
   positions. Texts are never shuffled: only hits of documents that have some are.
3. A file's words of highest IDF nominate templates: each template is filed under its rarest words, as many as it takes
   for the rest to weigh less than `least` of the whole. A file without any of these cannot reach the score, so the stop
   is exact, however many notices a file holds, and frequent words nominate nothing.
4. For nominated templates whose mandatory phrase stands in the text, all hits meet their postings; postings that agree on
   (word position - template position) add up their IDF, and the best alignment's share of the template's weight is its
   score.

The index is as large as TEMPLATES and PHRASES (some hundred postings, whatever the corpus): its counts are read by the
driver and its joins are broadcast.

Defined results: null and empty texts have no words and no labels; a text of any length is read whole, and all notices
in it count; alignments that tie give all their labels; a template of stop words only gives no label of its own; repeated
rows are scanned each for itself; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, whole_text

#: So few documents do not make a word a stop word, whatever share of all they are.
FEW = 50

#: Words after A-Z are lower-cased: ASCII letters and digits, and everything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrase -> label. They label a text wherever their words stand consecutively.
PHRASES: dict[str, str] = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, mandatory phrase, notice of common public licenses.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "mit license", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("gpl-2", "gnu general public license version 2", "under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gfdl", "gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("artistic", "artistic license", "you can redistribute it and or modify it under the terms of the artistic license"),
    ("artistic", "same terms as perl itself", "this library is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("zlib", "without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("bsl", "boost software license", "distributed under the boost software license version 1 0"),
    ("busl", "business source license", "use of this software is governed by the business source license"),
    ("ofl", "sil open font license", "this font software is licensed under the sil open font license version 1 1"),
    ("eupl", "european union public licence", "licensed under the eupl european union public licence"),
    ("ms-pl", "microsoft public license", "this source is subject to the microsoft public license"),
    ("psf", "python software foundation license", "licensed under the python software foundation license version 2"),
    ("php", "php license", "this source file is subject to version 3 01 of the php license"),
    ("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("openssl", "openssl license", "licensed under the openssl license you may not use this file except in compliance with the license"),
    ("ncsa", "ncsa open source license", "university of illinois ncsa open source license"),
    ("odbl", "open database license", "made available under the open database license"),
    ("afl", "academic free license", "licensed under the academic free license version 3 0"),
    ("osl", "open software license", "licensed under the open software license version 3 0"),
    ("lppl", "latex project public license", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("cecill", "cecill license", "this software is governed by the cecill license under french law"),
    ("cc0", "public domain dedication", "cc0 1 0 universal public domain dedication"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa", "cc by nc sa", "licensed under cc by nc sa 4 0"),
    ("gpl", "spdx license identifier gpl", "spdx license identifier gpl"),
    ("lgpl", "spdx license identifier lgpl", "spdx license identifier lgpl"),
    ("agpl", "spdx license identifier agpl", "spdx license identifier agpl"),
    ("apache", "spdx license identifier apache", "spdx license identifier apache"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("bsd", "spdx license identifier bsd", "spdx license identifier bsd"),
    ("mpl", "spdx license identifier mpl", "spdx license identifier mpl"),
    ("isc", "spdx license identifier isc", "spdx license identifier isc"),
    ("epl", "spdx license identifier epl", "spdx license identifier epl"),
)

def index() -> list[tuple[int, str, str, int, str]]:
    """(template, label, mandatory phrase, position, word); base phrases are templates too."""
    rows = [*((label, phrase, phrase) for phrase, label in PHRASES.items()), *TEMPLATES]
    return [(t, label, phrase, at, word) for t, (label, phrase, notice) in enumerate(rows) for at, word in enumerate(notice.split())]


def phrases() -> list[str]:
    """Base and mandatory phrases."""
    return sorted({*PHRASES, *(mandatory for _, mandatory, _ in TEMPLATES)})


def _words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.regexp_extract_all(F.translate(whole_text(), ascii_uppercase, ascii_lowercase), F.lit(WORDS), F.lit(0)).alias("_w"))


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of documents, and in how many of them each word of the templates and phrases stands. Only counts are shuffled."""
    vocabulary = sorted({r[4] for r in index()} | {w for p in phrases() for w in p.split()})
    known = F.array(*[F.lit(w) for w in vocabulary])
    # one more entry counts the documents themselves
    found = _words(docs).select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(known, "_w"))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}  # the vocabulary's size
    return counts.pop("", 0), {w: counts.get(w, 0) for w in vocabulary}


def postings(n: int, df: dict[str, int], common: float, least: float) -> list[tuple[int, str, str, int, str, float, float, bool]]:
    """(template, label, phrase, position, word, idf, whole weight, nominates) of all words but stop words.

    A template's rarest words nominate it, until those that are left weigh less than `least` of the whole.
    """
    idf = {w: math.log((n + 1.0) / (k + 0.5)) for w, k in df.items() if k <= max(common * n, FEW)}
    kept = [(*r, idf[r[4]]) for r in index() if r[4] in idf]
    out = []
    for t in sorted({r[0] for r in kept}):
        own = sorted((r for r in kept if r[0] == t), key=lambda r: (-r[5], r[4], r[3]))
        whole = left = sum(r[5] for r in own)
        words: set[str] = set()  # a word that stands twice in a template nominates once for both
        for r in own:
            if r[4] not in words and left >= least * whole * (1 - 1e-9):
                words.add(r[4])
                left -= sum(x[5] for x in own if x[4] == r[4])
        out += [(*r, whole, r[4] in words) for r in own]
    return out


def _starts(phrase: str, df: dict[str, int]) -> Column:
    """Places where the phrase's words stand consecutively, found from its rarest word."""
    words = phrase.split()
    at = min(range(len(words)), key=lambda i: (df[words[i]], i))

    def stands(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.coalesce(F.get("_w", i + (k - at)) == w, F.lit(False)) for k, w in enumerate(words)])

    return F.transform(F.filter("_at", stands), lambda i: i - at)


def reduce_texts(docs: DataFrame, df: dict[str, int], indexed: list[str]) -> DataFrame:
    """Row id, doc_id, n_words, starts of each base phrase, phrases that stand in the text, and hits (word, pos)."""
    every = phrases()
    wanted = sorted({*indexed, *(min(p.split(), key=lambda w: df[w]) for p in every)})
    found = _words(docs).select("doc_id", "_w", F.array_compact(F.transform("_w", lambda w, i: F.when(w.isin(*wanted), i))).alias("_at"))
    placed = found.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        *[_starts(p, df).alias(f"_p{i}") for i, p in enumerate(every)],
        F.filter(F.transform("_at", lambda i: F.struct(F.get("_w", i).alias("word"), i.alias("pos"))), lambda h: h["word"].isin(*indexed)).alias("hits"),
    )
    base = {p: F.col(f"_p{i}") for i, p in enumerate(every) if p in PHRASES}
    return placed.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        "n_words",
        F.concat(*base.values()).alias("starts"),
        F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(PHRASES[p])) for p, c in base.items()])).alias("base"),
        F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(p)) for i, p in enumerate(every)])).alias("phrases"),
        "hits",
    )


def align(reduced: DataFrame, rows: list[tuple], least: float) -> DataFrame:
    """(rid, found labels, score) of rows whose indexed words align with some template. rows: see postings()."""
    spark: SparkSession = reduced.sparkSession
    posted = F.broadcast(spark.createDataFrame(rows, "template int, label string, phrase string, tpos int, word string, idf double, whole double, nominates boolean"))
    with_hits = reduced.where((F.size("hits") > 0) & (F.size("phrases") > 0)).select("rid", "phrases", "hits")
    # the rare words that a file holds nominate, each once
    rare = with_hits.select("rid", "phrases", F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
    nominated = rare.join(posted.where("nominates").select("template", "phrase", "word").distinct(), "word").where(F.array_contains("phrases", F.col("phrase")))
    templates = nominated.groupBy("rid").agg(F.collect_set("template").alias("templates"))  # the number of templates at most
    looked = with_hits.select("rid", F.explode("hits").alias("h")).join(templates, "rid").select("rid", "templates", F.col("h.word").alias("word"), F.col("h.pos").alias("pos"))
    looked = looked.join(posted, "word").where(F.array_contains("templates", F.col("template")))
    # each posting counts once at an offset, so the weights that agree on it just add up
    at_offset = looked.groupBy("rid", "template", "label", "whole", (F.col("pos") - F.col("tpos")).alias("offset")).agg(F.sum("idf").alias("held"))
    scored = at_offset.groupBy("rid", "template", "label").agg(F.max(F.least(F.lit(1.0), F.col("held") / F.greatest("whole", F.lit(1e-9)))).alias("score"))
    return scored.where(F.col("score") >= least).groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("score").alias("score"))


def scan(docs: DataFrame, common: float = 0.2, least: float = 0.5) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    common: words of more than this share of all documents, and of more than FEW, are stop words. least: the share of a template's weight that
    its best alignment must hold.
    """
    docs = docs.select("doc_id", "text")
    n, df = document_frequencies(docs)
    rows = postings(n, df, common, least)
    reduced = cut(reduce_texts(docs, df, sorted({r[4] for r in rows})))
    joined = reduced.join(align(reduced, rows, least), "rid", "left")
    labels = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
