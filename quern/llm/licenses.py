"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word pair of every text is hash-joined with the pairs of a fixed set of templates.
A match at text word i of template word j votes for diagonal i - j. Votes are summed per
document, template and diagonal; neighbouring diagonals (words put in or left out) are merged;
a merged span is verified by the share of the template's pairs it holds and by its length.

Templates are a constant of this module (a few hundred pairs), so broadcasting them is bounded.
Every joined pair is compared word by word, so hash collisions never count.

Defined results: a null text is an empty text; texts are read whole, however long; of spans that cover their
templates alike none is preferred, as labels are a set and the score is the largest share; rows that
repeat doc_id and text are each returned; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The base phrases and their labels, then notices by which the method adds labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
NOTICES = (
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-notice", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-notice", "this work is licensed under a creative commons attribution international license"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense-notice", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib-notice", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("epl-notice", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


ALL = PHRASES + NOTICES
N_PAIRS = [len(words.split()) - 1 for _, words in ALL]


def templates(spark: SparkSession) -> DataFrame:
    """One row per template word pair, and one (template -1) that every text's start marker meets."""
    rows = ["(-1, 0, CAST(NULL AS STRING), CAST(NULL AS STRING))"]
    for tid, (_, words) in enumerate(ALL):
        w = words.split()
        rows += [f"({tid}, {j}, '{a}', '{b}')" for j, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    df = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(tid, tpos, w1, w2)")
    return df.withColumn("gram", F.when(F.col("tid") == -1, F.lit(0).cast("bigint")).otherwise(F.xxhash64("w1", "w2")))


def pairs() -> Column:
    """Word pairs of a row's template; null for the start marker."""
    return F.get(F.array(*[F.lit(n) for n in N_PAIRS]), F.col("tid"))


def is_base() -> Column:
    return F.col("tid").between(0, len(PHRASES) - 1)


def label() -> Column:
    return F.get(F.array(*[F.lit(name) for name, _ in ALL]), F.col("tid"))


def votes(docs: DataFrame) -> DataFrame:
    """Votes by document, template and diagonal: a bit for each template pair met, and the places.

    The text's words are exploded once. Neither the word list nor the second word of a pair is
    copied for a row unless the join keeps it. A marker before the words gives each document
    a row of its own (template -1) that carries its word count, so no second pass is needed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # lower() agrees with A-Z folding on ASCII words except for the two letters that it maps into ASCII.
    low = F.when(text.rlike("[\u0130\u212A]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    words = F.concat(F.array(F.lit("\x00")), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)))
    each = docs.select("doc_id", F.xxhash64("text").alias("h"), words.alias("words")).select("*", F.posexplode("words").alias("at", "word"))
    second = F.get("words", F.col("at") + 1)
    gram = F.when(F.col("at") == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64("word", second))
    t = F.broadcast(templates(docs.sparkSession))
    same = (F.col("at") == 0) | ((F.col("word") == F.col("w1")) & (second == F.col("w2")))
    met = each.withColumn("g", gram).join(t, (F.col("g") == F.col("gram")) & same)
    place = F.col("at") - 1
    return met.groupBy("doc_id", "h", "tid", (place - F.col("tpos")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("mask"),
        F.min(place).alias("first"),
        F.max(place + 1).alias("last"),
        F.count("*").alias("n"),
        F.max(F.size("words") - 1).alias("n_words"),
    )


def runs(voted: DataFrame, shift: int = 3, coverage: float = 0.6) -> DataFrame:
    """Votes merged over runs of diagonals at most ``shift`` apart, verified in column ``held``.

    A run is held if it has ``coverage`` of its template's pairs and is at most one and a half
    times as long as the template. ``n_base`` counts the diagonals on which a base phrase
    stands whole; they stay exact, whatever they merge with.
    """
    one = Window.partitionBy("doc_id", "h", "tid").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(one) > shift, F.lit(True))
    run = F.sum(apart.cast("int")).over(one.rowsBetween(Window.unboundedPreceding, 0))
    whole = is_base() & (F.col("mask") == F.call_function("shiftleft", F.lit(1).cast("bigint"), pairs()) - 1)
    is_doc = F.col("tid") == -1
    merged = (
        voted.withColumn("run", run)
        .withColumn("whole", F.coalesce(whole, F.lit(False)))
        .groupBy("doc_id", "h", "tid", "run")
        .agg(
            F.bit_or("mask").alias("mask"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.count_if("whole").alias("n_base"),
            F.min(F.when(F.col("whole"), F.col("diagonal"))).alias("first_word"),
            F.max(F.when(F.col("whole"), F.col("diagonal"))).alias("last_word"),
            F.max(F.when(is_doc, F.col("n"))).alias("copies"),
            F.max(F.when(is_doc, F.col("n_words"))).alias("n_words"),
        )
        .withColumn("cover", F.bit_count("mask") / pairs())
    )
    short = F.col("last") - F.col("first") + 1 <= 1.5 * (pairs() + 1)
    return merged.withColumn("held", F.coalesce((F.col("cover") >= coverage) & short, F.lit(False)))


def spans(docs: DataFrame, shift: int = 3, coverage: float = 0.6) -> DataFrame:
    """Verified spans: document, label, first and last word, share of the template held."""
    found = runs(votes(docs), shift, coverage).where("held")
    return found.select("doc_id", label().alias("label"), F.col("first").alias("first_word"), F.col("last").alias("last_word"), "cover")


def _labels(mask: str) -> Column:
    """The labels whose bits are set, sorted and joined."""
    names = sorted((name, 1 << tid) for tid, (name, _) in enumerate(ALL))
    return F.concat_ws(",", *[F.when(F.col(mask).bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in names])


def digest(docs: DataFrame, shift: int = 3, coverage: float = 0.6) -> DataFrame:
    """One row per document: word and phrase counts, places, labels and the best coverage as score."""
    found, whole = F.col("held"), F.col("n_base") > 0
    bit = F.call_function("shiftleft", F.lit(1), F.greatest(F.col("tid"), F.lit(0)))
    named = lambda c: F.coalesce(F.bit_or(F.when(c, bit)), F.lit(0))
    return (
        runs(votes(docs), shift, coverage)
        .groupBy("doc_id", "h")
        .agg(
            F.max("n_words").cast("bigint").alias("n_words"),
            F.sum("n_base").cast("bigint").alias("n_base"),
            F.min("first_word").cast("bigint").alias("first_word"),
            F.max("last_word").cast("bigint").alias("last_word"),
            named(whole).alias("base"),
            named(whole | (found & ~is_base())).alias("more"),
            F.coalesce(F.max(F.when(found | whole, F.greatest("cover", whole.cast("double")))), F.lit(0.0)).alias("score"),
            F.max("copies").alias("copies"),
        )
        .select(
            "doc_id", "n_words", "n_base", "first_word", "last_word",
            _labels("base").alias("base_labels"), _labels("more").alias("labels"), "score",
            F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"),
        )
        .drop("copy")
    )
