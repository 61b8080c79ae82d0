"""License scans by diagonal voting of word pairs against license templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.common import bind

# Phrases whose every occurrence counts: fixed values.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# Notices and opening passages by which licenses are told apart: fixed values.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
               "you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)

BROADCAST_PAIRS = 200_000


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits and of non-ASCII characters.

    Lower-casing a non-ASCII letter gives no ASCII separator, so word borders are those of
    the text; of the ASCII letters only ``k`` can come from another one (the Kelvin sign).
    """
    return F.array_remove(F.split(F.lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def template_table(spark: SparkSession, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(template, label, exact, text) of all templates, through SQL literals."""
    rows = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in templates]
    values = ", ".join("({}, '{}', {}, '{}')".format(i, label.replace("'", ""), str(exact).lower(), text.replace("'", "")) for i, (label, text, exact) in enumerate(rows))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, exact, text)")


def _pairs(w: Column) -> Column:
    """(position, word, next word) of all word pairs."""
    return F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.struct(
        i.alias("at"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"))))


def spans(docs: DataFrame, templates: DataFrame, text: str = "text", key: tuple[str, ...] = ("doc_id",), coverage: float = 0.7, drift: int = 3) -> DataFrame:
    """One row a place of ``docs`` that holds a template: key, template, label, exact, first_word, last_word, score.

    All word pairs of the whole texts are joined on their hash with the template positions
    (and compared as words), and every match votes for its diagonal, the position in the
    text less that in the template.  An exact template needs all votes of one diagonal.
    For the others a diagonal with two votes at least is merged with those not over
    ``drift`` from it, so that inserted or dropped words do no harm, and verified: ``score``
    is the share of the template's pairs that stand there in the template's order, each
    counted once.  Places under ``coverage`` go, and of places that share diagonals the best
    stays.

    ``key`` columns name a document; equal keys are taken as one document.  Null texts,
    texts and templates of fewer than two words have no places.  Votes are counted before
    any shuffle, and only pairs that templates hold take part in it, so a pair that a third
    of all texts repeats costs one row a diagonal.
    """
    wanted = templates.withColumn("_w", words(F.col("text"))).where(F.size("_w") >= 2).select(
        "template", "label", "exact", (F.size("_w") - 1).alias("pairs"), F.explode(_pairs(F.col("_w"))).alias("p"))
    wanted = wanted.select("template", "label", "exact", "pairs", F.col("p.at").alias("t_at"), F.col("p.a").alias("t_a"), F.col("p.b").alias("t_b"),
                           F.xxhash64("p.a", "p.b").alias("gram"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_PAIRS else wanted
    grams = docs.select(*key, F.explode(bind(words(F.col(text)), _pairs)).alias("p")).select(*key, "p.*")
    hits = grams.withColumn("gram", F.xxhash64("a", "b")).join(wanted, "gram").where("a = t_a AND b = t_b")
    # a template position votes for a diagonal once, so these lists are no longer than templates
    lines = hits.groupBy(*key, "template", "label", "exact", "pairs", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(F.collect_set(F.struct("t_at", "at")).alias("votes"))
    lines = lines.where(F.when(F.col("exact"), F.size("votes") == F.col("pairs")).otherwise(F.size("votes") >= F.least(F.lit(2), F.col("pairs"))))
    near = Window.partitionBy(*key, "template").orderBy("diagonal").rangeBetween(-drift, drift)
    around = F.when(F.col("exact"), F.col("votes")).otherwise(F.flatten(F.collect_list("votes").over(near)))
    reached = lines.withColumn("around", around).where(F.size(F.array_distinct(F.transform("around", lambda v: v["t_at"]))) >= coverage * F.col("pairs"))
    scored = reached.withColumn("score", _in_order(F.col("around")) / F.col("pairs")).where(F.col("score") >= coverage)
    rank = F.struct("score", (-F.col("diagonal")).alias("d"))
    best = scored.withColumn("best", F.col("exact") | (F.max(rank).over(near) == rank)).where("best")
    return best.select(*key, "template", "label", "exact", F.array_min(F.transform("around", lambda v: v["at"])).alias("first_word"),
                       (F.array_max(F.transform("around", lambda v: v["at"])) + 1).alias("last_word"), "score")


def _in_order(votes: Column) -> Column:
    """Most votes that follow each other both in the template and in the text.

    Taken by template position, the state holds the smallest text position at which a chain
    of each length can end; positions of one template word are taken from the last, so only
    one of them joins a chain.
    """
    ordered = F.array_sort(F.transform(votes, lambda v: F.struct(v["t_at"].alias("t"), (-v["at"]).alias("a"))))

    def add(ends: Column, v: Column) -> Column:
        shorter = F.size(F.filter(ends, lambda e: e < -v["a"]))
        return F.concat(F.slice(ends, F.lit(1), shorter), F.array(-v["a"]), F.slice(ends, shorter + 2, F.size(ends)))
    return F.size(F.aggregate(ordered, F.array().cast("array<int>"), add))


def scan(docs: DataFrame, templates: DataFrame | None = None, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with its license evidence: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of exact templates, ``first_word`` and ``last_word`` are
    the smallest and largest word at which one begins, ``score`` the best of all places (0
    without any).  Rows of one key are told apart by their text; a null text has no words.
    Columns of ``docs`` with the names of the results are replaced.
    """
    templates = template_table(docs.sparkSession) if templates is None else templates
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [c for c in docs.columns if c not in new]
    row = F.struct(*kept)
    marked = docs.select(row.alias("row")).select("row", F.col("row").getField(key).alias("id"), F.xxhash64(F.col("row").getField(text)).alias("digest"), F.col("row").getField(text).alias("body"))
    found = spans(marked, templates, "body", ("id", "digest"), **options)
    base = F.when(F.col("exact"), F.col("first_word"))
    evidence = found.groupBy(F.col("id").alias("_key"), F.col("digest").alias("_hash")).agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.collect_set(F.when(F.col("exact"), F.col("label"))).alias("_base"), F.collect_set("label").alias("_all"), F.max("score").alias("score"))
    joined = marked.withColumn("n_words", F.size(words(F.coalesce(F.col("body"), F.lit(""))))).join(
        evidence, F.col("id").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_hash")), "left")
    names = lambda c: F.concat_ws(",", F.array_sort(c))
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in kept], F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        names(F.col("_base")).alias("base_labels"), names(F.col("_all")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
