"""License scan by diagonal voting, in DataFrame operations only.

Every pair of neighbouring words of a document is joined, by hash, to the
places of the same pair in license templates; the words themselves (for a
notice, three in a row) confirm the hash.  A hit votes for its diagonal, the
document place less the template place.  A phrase stands where its diagonal
has all its votes.  A notice may have words changed: from each diagonal on,
those up to NEIGHBOURS further are merged, and where half of the template's
places have a vote the span is verified: the words between its first and last
hit, in their order, are held against the template by edit distance, words
that no hit confirms counting as changed.  Of overlapping spans the nearest to
its template stays, so that a notice isn't taken for one that differs in a word.

Rows are judged one by one, so repeated or null ids do no harm; a null text
is an empty one and gives zero counts, null places and no labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Phrases, found only whole. Fixed values.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: Notices of common licenses, found also with a few words changed. Fixed values.
NOTICES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: diagonals at most so far apart are one span: what a notice may gain or lose in words overall
NEIGHBOURS = 3
#: words of a text that no hit confirms
UNCONFIRMED = "?"


def template_rows(phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(template, label, whole, votes it has in all, pattern, place, word, next word, word after or null).

    The pattern has one letter for each of the template's words, equal ones alike.
    """
    rows = []
    for t, (label, text, whole) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        w = text.split()
        votes, letter = len(w) - (1 if whole else 2), {x: chr(65 + i) for i, x in enumerate(dict.fromkeys(w))}
        for i in range(votes):
            rows.append((t, label, whole, votes, "".join(map(letter.get, w)), i, w[i], w[i + 1], None if whole else w[i + 2]))
    return rows


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    schema = "template int, label string, whole boolean, votes int, pattern string, place int, t1 string, t2 string, t3 string"
    table = spark.createDataFrame(template_rows(phrases, notices), schema)
    return table.withColumn("key", F.xxhash64("t1", "t2"))


def _span_words(near: Column, pattern: Column) -> Column:
    """(first, last, read): the words from the first to the last hit of [(diagonal, places)], as letters of the pattern."""
    letters = F.flatten(
        F.transform(
            near,
            lambda d: F.flatten(
                F.transform(
                    d["places"],
                    lambda p: F.array(
                        *[
                            F.struct((d["diagonal"] + p + i).alias("at"), F.substring(pattern, p + 1 + i, F.lit(1)).alias("letter"))
                            for i in range(3)
                        ]
                    ),
                )
            ),
        )
    )
    known = F.map_from_entries(F.array_distinct(letters))  # a place has one word, so one letter
    first, last = F.array_min(F.map_keys(known)), F.array_max(F.map_keys(known))
    read = F.transform(F.sequence(first, last), lambda at: F.coalesce(F.try_element_at(known, at), F.lit(UNCONFIRMED)))
    return F.struct(first.alias("first"), last.alias("last"), F.array_join(read, "").alias("read"))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, share: float = 0.75) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    `share`: of a notice's words that must stand, by edit distance.  `score` is the largest such share,
    1 where a phrase stands, 0 without a label.
    """
    text = shared.lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = docs.select(
        F.col("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.array_remove(F.split(text, SEPARATORS), "").alias("words"),
    )
    n = F.size("words")
    following = [F.slice("words", k, F.greatest(n, F.lit(1))) for k in (2, 3)]
    zipped = F.arrays_zip(F.col("words").alias("w1"), following[0].alias("w2"), following[1].alias("w3"))
    placed = words.select("doc_id", "row", n.cast("long").alias("n_words"), F.posexplode_outer(zipped).alias("at", "w"))
    placed = placed.select("doc_id", "row", "n_words", "at", "w.w1", "w.w2", "w.w3", F.xxhash64("w.w1", "w.w2").alias("key"))

    known = F.broadcast(templates(docs.sparkSession, phrases, notices))  # a few hundred rows
    joined = placed.join(known, "key", "left")
    same = (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")) & (F.col("whole") | (F.col("w3") == F.col("t3")))
    hit = F.coalesce(same, F.lit(False))
    of_hit = [F.first(F.when(hit, F.col(c))).alias(c) for c in ("label", "whole", "votes", "pattern")]
    diagonal = F.when(hit, F.col("at") - F.col("place"))
    votes = (
        joined.where(hit | F.col("at").isNull() | (F.col("at") == 0))
        .groupBy("row", "doc_id", "n_words", F.when(hit, F.col("template")).alias("template"), diagonal.alias("diagonal"))
        .agg(F.collect_list(F.when(hit, F.col("place"))).alias("places"), *of_hit)  # as many as the template has
    )
    # Phrases keep their own diagonals; a notice's span is at most NEIGHBOURS + 1 diagonals from its first on.
    close = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, NEIGHBOURS)
    spans = votes.withColumn("near", F.collect_list(F.struct("diagonal", "places")).over(close))
    voted = F.size(F.array_distinct(F.flatten(F.transform("near", lambda d: d["places"]))))
    likely = F.when(~F.col("whole") & (2 * voted >= F.col("votes")), _span_words(F.col("near"), F.col("pattern")))
    base = F.coalesce(F.col("whole") & (F.size("places") >= F.col("votes")), F.lit(False))
    spans = spans.withColumns({"base": base, "span": likely})
    share_kept = 1 - F.levenshtein("pattern", "span.read") / F.length("pattern")
    spans = spans.withColumns({"kept": F.when(share_kept >= share, share_kept), "first": F.col("span.first"), "last": F.col("span.last")})
    # No span is longer than its template and the drift; so many words hold a bounded number of spans.
    longest = max([len(text.split()) for _, text in notices], default=0) + NEIGHBOURS
    around = Window.partitionBy("row").orderBy("first").rangeBetween(-longest, longest)
    others = F.collect_list(F.when(F.col("kept").isNotNull(), F.struct("first", "last", "kept"))).over(around)
    spans = spans.withColumn("others", others)
    better = F.exists(
        "others", lambda o: (o["first"] <= F.col("last")) & (o["last"] >= F.col("first")) & (o["kept"] > F.col("kept"))
    )
    noticed = F.coalesce(F.col("kept").isNotNull() & ~better, F.lit(False))
    spans = spans.select("row", "doc_id", "n_words", "label", "diagonal", "base", "kept", noticed.alias("noticed"))
    noticed = F.col("noticed")
    rows = spans.groupBy("row", "doc_id", "n_words").agg(
        F.sum(F.when(F.col("base"), 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base"),
        F.array_sort(F.collect_set(F.when(F.col("base") | noticed, F.col("label")))).alias("all"),
        F.coalesce(F.max(F.when(F.col("base"), 1.0).when(noticed, F.col("kept"))), F.lit(0.0)).alias("score"),
    )
    labels = [F.concat_ws(",", c).alias(x) for c, x in (("base", "base_labels"), ("all", "labels"))]
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", *labels, F.round("score", 6).alias("score"))
