"""Licence scan: a positional index of rare licence words.

The words of a few licence notices are postings (word, template, position). How rare each of these words is gets counted
over all texts. The rarest words of each template's mandatory key phrase are looked up in each file, postings that agree
on where the template would start are brought together, and such a place counts if the key phrase stands there word by
word. So every notice whose key phrase stands in a file is found, however many others stand beside it. Base phrases are
found independently of templates and of rarity.

Null texts have no words. A text with no licence word gets empty labels and score 0. Repeated rows each give a row, an
empty table none. Texts of any length are looked at as a whole. Of templates that tie all labels count; the score is the
largest share of a template's words that stand at their places. Other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Saved, ascii_lower

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, int]  # the mandatory phrase: from, to

    @classmethod
    def of(cls, label: str, before: str, key: str, after: str) -> Template:
        b, k, a = before.split(), key.split(), after.split()
        return cls(label, (*b, *k, *a), (len(b), len(b) + len(k)))


#: Notices that name a licence (words in lower case; the mandatory phrase in the middle).
TEMPLATES = (
    Template.of("gpl-3.0", "this work is licensed under the", "gnu general public license version 3", ""),
    Template.of("gpl-2.0", "this work is licensed under the", "gnu general public license version 2", ""),
    Template.of("lgpl", "licensed under the", "gnu lesser general public license", "version"),
    Template.of("agpl", "licensed under the", "gnu affero general public license", "version"),
    Template.of("apache-2.0", "licensed under the", "apache license version 2 0", ""),
    Template.of("mit", "released under the", "mit license", ""),
    Template.of("mit", "permission is hereby granted", "free of charge to any person obtaining a copy of this software", "and associated documentation files"),
    Template.of("cc-by-nc-4.0", "licensed under", "cc by nc 4 0", ""),
    Template.of("cc-by-sa-4.0", "licensed under", "cc by sa 4 0", ""),
    Template.of("cc-by-4.0", "licensed under", "cc by 4 0", ""),
    Template.of("bsd", "redistribution and use in", "source and binary forms with or without modification are permitted", "provided that the following conditions are met"),
    Template.of("mpl-2.0", "this source code form is subject to the terms of the", "mozilla public license v 2 0", ""),
    Template.of("isc", "permission to use copy modify", "and or distribute this software for any purpose with or without fee is hereby granted", ""),
    Template.of("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the", "gnu general public license as published by the free software foundation either version 3 of the license", "or at your option any later version"),
    Template.of("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the", "gnu general public license as published by the free software foundation either version 2 of the license", "or at your option any later version"),
    Template.of("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the", "gnu lesser general public license as published by the free software foundation", "either version"),
    Template.of("agpl", "this program is free software you can redistribute it and or modify it under the terms of the", "gnu affero general public license as published by the free software foundation", "either version 3 of the license"),
    Template.of("apache-2.0", "licensed under the apache license version 2 0 the license", "you may not use this file except in compliance with the license", "you may obtain a copy of the license at"),
    Template.of("mit", "including without limitation the rights to use copy modify merge publish", "distribute sublicense and or sell copies of the software", "and to permit persons to whom the software is furnished to do so"),
    Template.of("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote", "products derived from this software without specific prior written permission", ""),
    Template.of("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at", ""),
    Template.of("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the", "software and accompanying documentation covered by this license", "the software to use reproduce display distribute execute and transmit the software"),
    Template.of("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "arising from the use of this software permission is granted to anyone to use this software for any purpose", "including commercial applications"),
    Template.of("unlicense", "this is", "free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"),
    Template.of("epl-2.0", "this program and the accompanying materials are made available under the terms of the", "eclipse public license 2 0", "which is available at"),
    Template.of("cc-by-4.0", "this work is licensed under a", "creative commons attribution 4 0 international license", ""),
    Template.of("cc-by-sa-4.0", "this work is licensed under a", "creative commons attribution sharealike 4 0 international license", ""),
    Template.of("cc-by-nc-4.0", "this work is licensed under a", "creative commons attribution noncommercial 4 0 international license", ""),
    Template.of("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", "cc0 1 0 universal", ""),
)
#: A file with none of these holds no key phrase; each key phrase has one of them.
ANCHORS = ("apache", "cc", "cc0", "distribute", "license", "mpl", "permitted", "software")


def phrase_places(spaced: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(places, first, last) of a phrase in words that single spaces part and surround."""
    inner = f" {phrase} "
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    places = F.regexp_count(spaced, F.lit(f" {phrase}(?= )"))
    first = spaces(F.substring_index(spaced, inner, 1))
    last = n_words - spaces(F.substring_index(spaced, inner, -1)) - len(phrase.split())
    return places, F.when(places > 0, first), F.when(places > 0, last)


def scan(docs: DataFrame, saved: Saved, templates=TEMPLATES, base=BASE, id_col: str = "doc_id", text_col: str = "text", rarest: int = 4, anchors=ANCHORS) -> DataFrame:
    """One row for each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Templates are looked for in files that hold an anchor; each key phrase must have one."""
    for t in templates:
        if not set(t.words[slice(*t.key)]) & set(anchors):
            raise ValueError(f"no anchor in the key phrase of a template of {t.label}")
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in t.words} | {w for p in base for w in p.split()})
    known = F.array(*map(F.lit, vocabulary))
    words = F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS)
    d = docs.select(F.col(id_col), words.alias("_w"))
    # Only the first and the last can be empty
    lead = (F.element_at("_w", 1) == "").cast("int")
    tail = ((F.size("_w") > 1) & (F.element_at("_w", -1) == "")).cast("int")
    d = d.select(id_col, "_w", lead.alias("_lead"), tail.alias("_tail"), (F.size("_w") - lead - tail).cast("long").alias("n_words"), F.array_intersect("_w", known).alias("_known"))
    has = lambda w: F.array_contains("_known", w)
    marked = None
    for anchor in anchors:
        marked = has(anchor) if marked is None else marked | has(anchor)
    holds = None
    for phrase in base:
        every = None
        for w in phrase.split():
            every = has(w) if every is None else every & has(w)
        holds = every if holds is None else holds | every
    d = d.select(
        id_col, "n_words", "_known", "_lead",
        F.when(marked, F.filter(F.transform("_w", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(*vocabulary))).alias("_places"),
        F.when(holds, F.concat(F.when(F.col("_lead") == 1, "").otherwise(" "), F.array_join("_w", " "), F.when(F.col("_tail") == 1, "").otherwise(" "))).alias("_spaced"),
    )
    found = {label: phrase_places(F.col("_spaced"), F.col("n_words"), phrase) for phrase, label in base.items()}
    zero = F.lit(0)
    d = d.select(
        id_col, "n_words", "_known",
        F.expr("transform(_places, x -> struct(cast(x.i - _lead as int) as p, x.w as w))").alias("_places"),
        sum((F.coalesce(x[0], zero) for x in found.values()), zero).cast("long").alias("n_base"),
        F.array_min(F.array(*(x[1] for x in found.values()))).cast("long").alias("first_word"),
        F.array_max(F.array(*(x[2] for x in found.values()))).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(x[0] > 0, label) for label, x in found.items()))).alias("_base"),
        F.monotonically_increasing_id().alias("_row"),
    )
    d = saved.put(d, "files")

    # How rare each licence word is: a row for each word of the vocabulary at most
    seen = d.select(F.explode("_known").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    n = d.agg(F.count("*").alias("n")).scalar()
    idf = F.broadcast(saved.put(seen.select("w", F.log(n / F.col("df")).alias("idf")).repartition(1), "idf"))

    postings = spark.createDataFrame(
        [(k, t.label, i, w, len(t.words), t.key[0] <= i < t.key[1], t.key[1] - t.key[0]) for k, t in enumerate(templates) for i, w in enumerate(t.words)],
        "t int, label string, i int, w string, n int, key boolean, n_key int",
    ) if templates else spark.createDataFrame([], "t int, label string, i int, w string, n int, key boolean, n_key int")
    postings = F.broadcast(postings)
    places = d.where("size(_places) > 0").select("_row", F.explode("_places").alias("x")).select("_row", "x.p", "x.w")
    # Each template's rarest key words: a row for each word of the templates to sort. All of them stand where the phrase
    # does, so that no other notice in the file can displace them
    own = postings.where("key").join(idf, "w", "left").withColumn("k", F.row_number().over(W.partitionBy("t").orderBy(F.desc_nulls_first("idf"), "w", "i")))
    own = F.broadcast(saved.put(own.where(F.col("k") <= rarest).select("t", "i", "w", F.least("n_key", F.lit(rarest)).alias("asked")).coalesce(1), "lookup"))
    hits = places.join(own, "w").select("_row", "t", "asked", (F.col("p") - F.col("i")).alias("start")).groupBy("_row", "t", "asked", "start").agg(F.count("*").alias("hits"))
    starts = hits.where("hits = asked").select("_row", "t", "start")
    words_there = starts.join(postings, "t").select("_row", "t", "label", "start", "n", "n_key", "key", (F.col("start") + F.col("i")).alias("p"), "w")
    verified = words_there.join(places, ["_row", "p", "w"]).groupBy("_row", "t", "label", "start", "n", "n_key").agg(F.count("*").alias("same"), F.count(F.when(F.col("key"), 1)).alias("keys"))
    verified = verified.where("keys = n_key").groupBy("_row").agg(F.collect_set("label").alias("_own"), F.max(F.col("same") / F.col("n")).alias("_score"))  # labels: one of each template at most
    none = F.array().cast("array<string>")
    out = d.drop("_places", "_known").join(verified, "_row", "left")
    return out.select(
        id_col, "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_own", none)))), ",").alias("labels"),
        F.coalesce(F.greatest("_score", F.when(F.col("n_base") > 0, 0.5)), F.lit(0.0)).alias("score"),
    )
