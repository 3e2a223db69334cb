"""License scans as an exact set-similarity join, in DataFrame functions only.

Template notices are token sets. Each text is cut into words once, of which those that a template or phrase
has are kept with their places. Texts are taken as overlapping blocks of words, and every block that
contains at least the threshold share of a template's tokens is found: tokens are put in one global
order, rarest first by their count in the corpus; a block and a template can only match if their
prefixes in that order share a token, the block is long enough, and enough tokens are left after the
shared one (prefix, length and positional filters). What is left is verified exactly.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechreport.llm.common import materialize

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Openings of public license notices, and their labels.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
}

#: Short statements that name a version or terms, of which every word must stand in a block, and their labels.
STATEMENTS = {
    "gpl-2.0": "gnu general public license version 2",
    "gpl-3.0": "gnu general public license version 3",
    "agpl-3.0": "gnu affero general public license version 3",
    "lgpl-3.0": "gnu lesser general public license version 3",
    "apache-2.0": "apache license version 2 0",
    "mpl-2.0": "mozilla public license version 2 0",
    "cc-by-sa": "licensed under cc by sa",
    "cc-by-nc": "licensed under cc by nc",
    "cc-by-nd": "licensed under cc by nd",
    "all-rights-reserved": "all rights reserved",
}

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the smallest blocks of templates and of statements; blocks start at every half of their length.
BLOCK, STATEMENT_BLOCK = 64, 16
THRESHOLD = 0.8


def license_words(text: Column) -> Column:
    """Words of the text with A-Z in lower case; null has none.

    lower() also changes letters outside ASCII. That cannot make an ASCII word but for the Kelvin
    sign, which is replaced by another letter first; words with other letters match no template.
    """
    ascii_only = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "K", "Ω"))
    joined = F.btrim(F.regexp_replace(ascii_only, WORD_GAP, " "))
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def block_of(words: int, smallest: int = BLOCK) -> int:
    """Words of the blocks in which a template of so many words is sought: ``smallest`` doubled until it holds twice as many."""
    size = smallest
    while size < 2 * words:
        size *= 2
    return size


def hits(df: DataFrame, key: str, text: str, vocabulary: list[str]) -> DataFrame:
    """(_id, n_words, hits): places and words of each text that are in the vocabulary, in order. Each text is cut once."""
    cut = df.select(F.col(key).alias("_id"), license_words(F.col(text)).alias("_words"))
    own = F.array_compact(F.transform("_words", lambda w, i: F.when(w.isin(*vocabulary), F.struct(i.alias("i"), w.alias("w")))))
    return cut.select("_id", F.size("_words").cast("long").alias("n_words"), own.alias("hits"))


def matches(found: DataFrame, templates: dict[str, str], threshold: float = THRESHOLD, smallest: int = BLOCK) -> DataFrame:
    """(_id, label, block, start, containment) of every block of ``block`` words that meets the threshold, for rows of hits()."""
    spark = found.sparkSession
    tokens_of = {label: sorted(set(text.split())) for label, text in templates.items()}
    vocabulary = sorted({t for ts in tokens_of.values() for t in ts})
    # as many rows as the templates have tokens
    counts = {r["w"]: r["count"] for r in found.select(F.explode("hits.w").alias("w")).groupBy("w").count().collect()}
    order = sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    by_block: dict[int, list[str]] = {}
    for label, text in templates.items():
        by_block.setdefault(block_of(len(text.split()), smallest), []).append(label)
    parts = []
    for block, labels in by_block.items():
        rows = []
        for label in labels:
            ordered, need = sorted(tokens_of[label], key=rank.__getitem__), max(1, math.ceil(threshold * len(tokens_of[label]) - 1e-9))
            rows += [(t, i, label, ordered, len(ordered), need) for i, t in enumerate(ordered[: len(ordered) - need + 1])]
        parts.append(_in_blocks(found, block, order, spark.createDataFrame(rows, "token string, place int, label string, tokens array<string>, size int, need int"), {r[0] for r in rows}, min(r[5] for r in rows)))
    return functools.reduce(DataFrame.unionByName, parts)


def _in_blocks(found: DataFrame, block: int, order: list[str], prefixes: DataFrame, heads: set[str], least: int) -> DataFrame:
    """matches() for templates that share a length of block; least: the fewest tokens that any of them needs."""
    step = block // 2
    near = F.filter("hits", lambda h: h["w"].isin(*sorted(heads)))
    at = F.transform(near, lambda h: F.floor(h["i"] / step).cast("int") * step)
    starts = F.array_distinct(F.flatten(F.transform(at, lambda s: F.array(s, s - step))))
    starts = F.filter(starts, lambda s: (s == 0) | ((s > 0) & (s + (block - step) < F.col("n_words"))))
    blocks = found.select("_id", "hits", F.explode(starts).alias("start"))
    inside = F.transform(F.filter("hits", lambda h: (h["i"] >= F.col("start")) & (h["i"] < F.col("start") + block)), lambda h: h["w"])
    # the block's tokens that any template has, in the global order; no other token can count
    blocks = blocks.select("_id", "start", F.array_intersect(F.array(*[F.lit(t) for t in order]), inside).alias("own")).filter(F.size("own") >= least)
    probes = blocks.select("_id", "start", "own", F.posexplode(F.slice("own", F.lit(1), F.size("own") - least + 1)).alias("at", "token"))
    # as many rows as the templates' prefixes have
    pairs = probes.join(F.broadcast(prefixes), "token").filter(
        (F.size("own") >= F.col("need")) & (1 + F.least(F.size("own") - F.col("at") - 1, F.col("size") - F.col("place") - 1) >= F.col("need"))
    )
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("own", "tokens"))).filter(F.col("shared") >= F.col("need"))
    return pairs.groupBy("_id", "label", "start").agg(F.max(F.col("shared") / F.col("size")).alias("containment")).withColumn("block", F.lit(block))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, statements: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of df: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a phrase stands, else the largest containment of a template or statement in a block that
    meets the threshold, which is 1 for statements, else 0. A statement is found as a set, so its words may stand in any order within
    a block of STATEMENT_BLOCK words. Null and empty texts have no words, no labels and score 0; very long texts
    are scanned whole. Rows that share a key, null included, share the labels that the method finds in any
    of them; repeated rows give a row each, an empty table none. Other columns of df are not read.
    """
    phrases, templates, statements = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates, STATEMENTS if statements is None else statements
    vocabulary = sorted({w for told in (*phrases, *templates.values(), *statements.values()) for w in told.split()})
    found = materialize(hits(df, key, text, vocabulary))

    def places(phrase: str) -> Column:
        first, *rest = phrase.split()
        follows = lambda h, j: _all([h["w"] == first, *[F.get("hits", j + k) == F.struct((h["i"] + k).alias("i"), F.lit(w).alias("w")) for k, w in enumerate(rest, 1)]])
        return F.transform(F.filter("hits", follows), lambda h: h["i"])

    names = [f"_p{i}" for i in range(len(phrases))]
    base = found.select("_id", "n_words", *[places(p).alias(n) for n, p in zip(names, phrases, strict=True)])
    labelled = F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, phrases.values(), strict=True)]))
    every = F.flatten(F.array(*names))
    base = base.select("_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labelled)).alias("_base"))
    near = [matches(found, told, least, smallest) for told, least, smallest in ((templates, threshold, BLOCK), (statements, 1.0, STATEMENT_BLOCK)) if told]
    none = found.sparkSession.createDataFrame([], found.select("_id", F.lit("").alias("label"), F.lit(0.0).alias("containment")).schema)
    more = functools.reduce(DataFrame.unionByName, [m.select("_id", "label", "containment") for m in near], none).groupBy("_id").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_score"))
    more = materialize(more.withColumnRenamed("_id", "_match"))
    joined = base.join(more, F.col("_id").eqNullSafe(F.col("_match")), "left")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0)))
    labels = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    return joined.select(
        F.col("_id").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def _all(conditions: list[Column]) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found = found & c
    return found
