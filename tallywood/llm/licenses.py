"""Licence texts in documents by diagonal voting, and fixed phrases.

All rolling word 3-grams of the documents are joined to the places where licence templates have them.
Hits of one template on one diagonal (document place less template place) vote together; neighbouring
diagonals merge, so a few inserted or dropped words do no harm; a merged span that covers enough of
the template counts. All of it is DataFrame functions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywood.llm import _shared

#: Words of a gram.
GRAM = 3
#: Diagonals at most so far apart belong together.
NEAR = 3
#: Share of a template's grams that a span covers at least.
COVER = 0.6
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# The label and text of licence notices.
TEMPLATES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "All rights reserved"),
)


def words_of_template(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in _UPPER else c for c in text))


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``hash, w0, w1, w2, at array<struct<template, place>>``: where the templates have each gram."""
    rows: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for t, (_, text) in enumerate(templates):
        words = words_of_template(text)
        for i in range(len(words) - GRAM + 1):
            rows.setdefault(tuple(words[i : i + GRAM]), []).append((t, i))
    data = [(*gram, at) for gram, at in rows.items()]
    grams = spark.createDataFrame(data, "t0 string, t1 string, t2 string, at array<struct<template:int,place:int>>")
    return grams.withColumn("hash", F.xxhash64("t0", "t1", "t2"))


def _windows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``row, doc_id, place, w0, w1, ...``: every word with those after it, and a row of nulls after the last."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.array_remove(F.split(text, _SPLIT, -1), "").alias("words"))
    ended = own.withColumn("words", F.concat("words", F.array(F.lit(None).cast("string"))))
    zipped = F.arrays_zip(*((F.col("words") if k == 0 else F.slice("words", F.lit(k + 1), F.greatest(F.size("words") - k, F.lit(0)))).alias(f"w{k}") for k in range(width)))
    rows = ended.select("row", "doc_id", F.posexplode_outer(zipped).alias("place", "w"))
    return rows.select("row", "doc_id", "place", *(F.col(f"w.w{k}").alias(f"w{k}") for k in range(width)))


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES) -> DataFrame:
    """``doc_id, n_words, phrases, spans`` for every row of ``docs``.

    ``phrases array<struct<place, label>>`` are the places where all words of a fixed phrase stand;
    ``spans array<struct<label, first, last, cover>>`` the stretches that cover at least COVER of a
    template, with that share. Words are runs of letters and digits with A-Z lower-cased. A null text
    counts as empty; rows with one id stay apart; an empty table gives no rows.
    """
    spark = docs.sparkSession
    width = max(GRAM, *(len(p.split()) for p in phrases))
    rows = _windows(docs, id_col, text_col, width)
    label = F.coalesce(*(F.when(_all(p.split()), F.lit(name)) for p, name in phrases.items()))
    rows = rows.select("row", "doc_id", "place", "w0", "w1", "w2", label.alias("label"))
    # the templates are fixed, so their grams are a few kilobytes whatever the corpus
    grams = F.broadcast(template_grams(spark, templates))
    same = (F.xxhash64("w0", "w1", "w2") == F.col("hash")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    rows = rows.join(grams, same, "left").where("w0 is null or label is not null or at is not null")
    rows = _shared.cut(rows.select("row", "doc_id", "place", "label", "at", F.col("w0").isNull().alias("end")))
    hits = rows.where("at is not null").select("row", F.col("place"), F.explode("at").alias("at"))
    hits = hits.select("row", "at.template", F.col("at.place").alias("own"), "place", (F.col("place") - F.col("at.place")).alias("diagonal"))
    votes = hits.groupBy("row", "template", "diagonal").agg(F.collect_set("own").alias("own"), F.min("place").alias("first"), F.max("place").alias("last"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    group = F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= NEAR, 0).otherwise(1)).over(order)
    votes = votes.withColumn("group", group)
    size = F.element_at(F.array(*(F.lit(len(words_of_template(t)) - GRAM + 1) for _, t in templates)), F.col("template") + 1)
    names = F.element_at(F.array(*(F.lit(name) for name, _ in templates)), F.col("template") + 1)
    # a template has a bounded number of places, so the sets of a group are bounded
    merged = votes.groupBy("row", "template", "group").agg(F.size(F.array_distinct(F.flatten(F.collect_set("own")))).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    merged = merged.withColumn("cover", F.col("n") / size).where(F.col("cover") >= COVER)
    spans = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(names.alias("label"), "first", (F.col("last") + GRAM - 1).alias("last"), "cover"))).alias("spans"))
    found = rows.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("end"), F.col("place"))).cast("long").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("place", "label")))).alias("phrases"),
    )
    empty = F.array().cast("array<struct<label:string,first:int,last:int,cover:double>>")
    return found.join(spans, "row", "left").select("doc_id", "n_words", "phrases", F.coalesce("spans", empty).alias("spans"))


def _all(words: list[str]):
    out = F.col("w0") == words[0]
    for k, w in enumerate(words[1:], 1):
        out = out & (F.col(f"w{k}") == w)
    return out


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(_shared.table(spark, sf_dir, "documents"))
    places, base = F.transform("phrases", lambda p: p["place"]), F.transform("phrases", lambda p: p["label"])
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    sure = F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)), F.when(F.size("phrases") > 0, 1.0).otherwise(0.0))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"), sure.alias("score"),
    )
