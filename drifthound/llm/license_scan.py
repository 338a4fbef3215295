"""License scan by diagonal voting.

All rolling word 3-gram hashes of every text are joined to the positions of
the same hashes in license templates; the three words are compared too, so a
vote is never a hash collision. A vote at document word i and template word j
lies on the diagonal i - j. Votes are gathered by diagonal, diagonals at most
`gap` apart are merged (a word put in or left out moves the diagonal by one),
and a merged span counts if its votes cover `coverage` of the template.

Base phrases must stand word for word: every 3-gram votes on one diagonal.
Longer templates add labels of their own.

Null and empty texts have no words and no labels; texts of one or two words
have no 3-gram; repeated rows each get the same row; an empty table gives an
empty result; no other column is read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ALNUM_WORD

#: Phrases of the contract and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Further notices as they are usually written.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("reserved", "all rights reserved"),
)


def template_grams(phrases=PHRASES, templates=TEMPLATES, k: int = 3) -> list[tuple]:
    """(template number, label, base, grams in all, position, words...) for each k-gram."""
    rows = []
    for t, (label, text, base) in enumerate([(*p, True) for p in phrases] + [(*p, False) for p in templates]):
        words = text.split()
        n = len(words) - k + 1
        if not 1 <= n <= 62:
            raise ValueError(f"a template has {k} to {k + 61} words: {text}")
        rows += [(t, label, base, n, j, *words[j : j + k]) for j in range(n)]
    return rows


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, gap: int = 3, coverage: float = 0.6) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    spark = docs.sparkSession
    # a few hundred rows at most, whatever the input
    grams = F.broadcast(spark.createDataFrame(template_grams(phrases, templates), "t int, label string, base boolean, n int, j int, a string, b string, c string").withColumn("h", F.xxhash64("a", "b", "c")))
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(ALNUM_WORD), F.lit(0))
    read = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text"), words.alias("w"))
    zipped = F.arrays_zip(F.col("w").alias("x"), F.expr("slice(w, 2, size(w))").alias("y"), F.expr("slice(w, 3, size(w))").alias("z"))
    rolled = read.select("_id", "_text", F.posexplode(zipped).alias("i", "g")).select("_id", "_text", "i", F.col("g.x").alias("x"), F.col("g.y").alias("y"), F.col("g.z").alias("z"))
    votes = rolled.join(grams, (F.xxhash64("x", "y", "z") == F.col("h")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")) & (F.col("z") == F.col("c")))
    diagonals = votes.groupBy("_id", "_text", "t", "label", "base", "n", (F.col("i") - F.col("j")).cast("long").alias("d")).agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))
    by = W.partitionBy("_id", "_text", "t").orderBy("d")
    opened = F.when(F.col("d") - F.lag("d").over(by) <= gap, 0).otherwise(1)
    marked = diagonals.withColumn("_opened", opened).withColumn("span", F.sum("_opened").over(by))
    exact = F.col("base") & (F.bit_count("mask") == F.col("n"))
    spans = marked.groupBy("_id", "_text", "t", "label", "base", "n", "span").agg(
        F.bit_count(F.bit_or("mask")).alias("covered"), F.count(F.when(exact, 1)).alias("places"),
        F.min(F.when(exact, F.col("d"))).alias("first"), F.max(F.when(exact, F.col("d"))).alias("last"), F.min("d").alias("start"),
    )
    part = F.col("covered") / F.col("n")
    found = F.col("base") & (F.col("places") > 0)
    per_doc = spans.groupBy("_id", "_text").agg(
        F.sum(F.when(found, F.col("places")).otherwise(0)).alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(found | (~F.col("base") & (part >= coverage)), F.col("label")))), ",").alias("labels"),
        F.max(F.when(found, 1.0).when(~F.col("base"), part).otherwise(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(found | (~F.col("base") & (part >= coverage)), F.struct("start", "label")))).alias("spans"),
    )
    every = read.select("_id", "_text", F.size("w").cast("long").alias("n_words"))
    p = per_doc.withColumnsRenamed({"_id": "_i", "_text": "_t"})
    return every.join(p, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_t")), "left").select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
