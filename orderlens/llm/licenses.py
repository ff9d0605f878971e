"""License scan by diagonal voting.

All rolling word bigrams of a text are joined with the bigrams of license phrases
and templates (a fixed broadcast table), on their hash and then their words; for
templates the third word must agree too. A hit at word i of the text and word j
of the template votes for the diagonal i - j. Votes are added up per diagonal,
neighbouring diagonals of a template are merged (a word put in or left out moves
the rest of a text to the next diagonal), and a merged span is verified: enough
of the template's positions hit, within a stretch not much longer than the
template. A phrase of n words stands where a single diagonal has n - 1 votes.

Only DataFrame functions are used. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of
the lower-cased text. Defined results: null and empty texts have no words; every
row gives one row, repeated rows included; doc_id may be null; score is 1 where a
phrase stands, else the best coverage of a verified span, else 0. An empty table gives
an empty result; other columns, whatever their names, are not looked at. A text is
split as a whole in one task, however long, and only its hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.llm.common import pick

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Passages of public license texts and notices, with the method's labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files the software to deal in the software without "
     "restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this "
     "file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the "
     "terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
     "without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
NEIGHBOURS = 3
COVERAGE = 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_rows() -> list[tuple]:
    """(template, label, base, length, place, first, second, third) per bigram."""
    rows = []
    listed = [(label, text, True) for text, label in PHRASES.items()]
    listed += [(label, text, False) for label, text in TEMPLATES]
    for number, (label, text, base) in enumerate(listed):
        words = text.split()
        last = len(words) - (1 if base else 2)
        for place in range(last):
            third = None if base else words[place + 2]
            rows.append((number, label, base, last, place, words[place], words[place + 1], third))
    return rows


def _templates(spark: SparkSession) -> DataFrame:
    plain = spark.createDataFrame(
        template_rows(),
        "template int, label string, base boolean, length int, place int, t0 string, t1 string, t2 string",
    )
    return plain.withColumn("hash", F.xxhash64("t0", "t1"))


def scan(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), SEPARATORS), "")
    texts = pick(documents, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        words.alias("words"),
    )
    # Place -1 is a mark that carries the document itself through the join.
    places = texts.select(
        "doc_id",
        "row",
        "words",
        F.size("words").alias("n_words"),
        F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - 2, F.lit(-1)))).alias("at"),
    )
    word = [F.get("words", F.col("at") + i) for i in range(3)]
    grams = places.select(
        "doc_id", "row", "n_words", "at",
        word[0].alias("w0"), word[1].alias("w1"), word[2].alias("w2"),
        F.when(F.col("at") >= 0, F.xxhash64(word[0], word[1])).alias("gram"),
    )
    known = F.broadcast(_templates(documents.sparkSession))
    same = (
        (F.col("gram") == F.col("hash"))
        & (F.col("w0") == F.col("t0"))
        & (F.col("w1") == F.col("t1"))
        & (F.col("t2").isNull() | (F.col("w2") == F.col("t2")))
    )
    hits = grams.join(known, same, "left").where("at = -1 OR template IS NOT NULL")
    votes = hits.groupBy(
        "row", "template", (F.col("at") - F.col("place")).alias("diagonal")
    ).agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.max("label").alias("label"),
        F.max("base").alias("base"),
        F.max("length").alias("length"),
        F.count("template").alias("votes"),
        F.min("at").alias("low"),
        F.max("at").alias("high"),
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS)
    merged = (
        votes.withColumn("fresh", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("fresh").over(along))
        .groupBy("row", "template", "span")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.max("label").alias("label"),
            F.max("base").alias("base"),
            F.max("length").alias("length"),
            F.sum("votes").alias("votes"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
    )
    covered = F.least(F.lit(1.0), F.col("votes") / F.col("length"))
    fits = F.col("high") - F.col("low") + 1 <= F.col("length") * 1.5 + NEIGHBOURS
    stands = F.col("base") & (F.col("votes") == F.col("length"))
    spans = merged.withColumn("stands", F.coalesce(stands, F.lit(False))).withColumn(
        "cover", F.when(~F.col("base") & fits & (covered >= COVERAGE), covered)
    )
    found = F.col("stands") | F.col("cover").isNotNull()
    joined = lambda condition: F.array_join(
        F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ","
    )
    return (
        spans.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").cast("bigint").alias("n_words"),
            F.count_if("stands").cast("bigint").alias("n_base"),
            F.min(F.when(F.col("stands"), F.col("low"))).cast("bigint").alias("first_word"),
            F.max(F.when(F.col("stands"), F.col("low"))).cast("bigint").alias("last_word"),
            joined(F.col("stands")).alias("base_labels"),
            joined(found).alias("labels"),
            F.coalesce(
                F.max(F.when(F.col("stands"), F.lit(1.0)).otherwise(F.col("cover"))), F.lit(0.0)
            ).alias("score"),
            F.count_if(found).cast("bigint").alias("n_spans"),
        )
        .drop("row")
    )
