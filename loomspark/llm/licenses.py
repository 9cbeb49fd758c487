"""License scans by an exact set-similarity join.

For a template of n words the blocks of a text are all its windows of 2 n words that begin at a multiple of n, so a notice
that is no longer than its template lies within a block wherever it stands and however its lines are wrapped. The distinct words of a block
and of a template are sets, and a block meets a template if it contains at least ``THRESHOLD`` of the template's words, and those that tell
it from its like (``mit``, ``nc``). Both sides are put in one global order, the rarest word of the corpus first, by document
frequencies counted over the whole table. Then

* prefix filter: a qualifying pair shares a word within the first ``n - need + 1`` of the template; only blocks round such words are made;
* length filter: a block with fewer than ``need`` words can't qualify;
* positional filter: what is left behind the first shared word must still reach ``need``;

and what passes is verified by its whole overlap. Templates are a fixed list in this file, so the join's small
side stands in the plan as literals; no block is shuffled. Texts without any prefix word are never
split into words.

Base labels come from phrases (runs of words) wherever they stand. Null texts are empty ones; an empty table
has no frequencies, and words are then ordered alphabetically. Only DataFrame and SQL functions run here.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import documents, running

# Fixed phrases and their labels
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices: label, words, and those that must not be missing.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache"),
    (
        "apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "apache",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "attribution"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "nc"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu"),
    (
        "gpl-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "gnu",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    ("mit", "Released under the MIT License", "mit"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "charge"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
)
THRESHOLD = 0.8
#: Words of lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words. A class of ranges is a bit table to the regex engine, a negated one a chain of
#: predicates, so texts are split between words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(words) -> str:
    return f"array({', '.join(map(_q, words))})" if words else "CAST(array() AS array<string>)"


def _words(text: str) -> str:
    return f"array_remove(split({text}, {_q(_BETWEEN + '+')}, -1), '')"


def template_words(templates=TEMPLATES) -> dict[str, tuple[int, list[str], list[str]]]:
    """Of each label the number of words, the distinct ones and those that must not be missing."""
    import re

    found = {}
    for label, text, marks in templates:
        words = re.findall(WORD, text.lower())
        found[label] = len(words), sorted(set(words)), marks.split()
    return found


def frequencies(df: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many of the texts in ``lower`` each word of the fixed vocabulary stands: a row for each word at most."""
    met = df.select(F.explode(F.expr(f"array_intersect({_words('lower')}, {_array(vocabulary)})")).alias("word"))
    return {r["word"]: r["n"] for r in met.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _lower(df: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    """``_row`` with the kept columns and ``lower``, in which A to Z alone are lower-cased."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    kept = [F.col(f"`{c}`") for c in keep] or [F.lit(None).alias("_none")]
    rows = df.select(F.struct(*kept).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # of ASCII texts both are the same, and the first costs less
    return rows.select("_row", F.expr(f"CASE WHEN octet_length(text) = char_length(text) THEN lower(text) ELSE translate(text, '{upper}', '{small}') END").alias("lower"))


def join_blocks(df: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``found``: (label, containment) of every template that a block of ``lower`` meets."""
    sets = template_words(templates)
    vocabulary = sorted({w for _, words, _ in sets.values() for w in words})
    counts = frequencies(df, vocabulary)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    tables = []
    for label, (n, words, marks) in sorted(sets.items()):
        ranked = sorted(words, key=rank.__getitem__)
        need = ceil(threshold * len(ranked) - 1e-9)
        tables.append((label, n, ranked, ranked[: len(ranked) - need + 1], need, marks))
    firsts = sorted({w for t in tables for w in t[3]}, key=rank.__getitem__)
    # a text holds a prefix word as a run of letters at least: cheap, and never wrong as the words are looked at after
    some = _q("(?:" + "|".join(sorted(firsts, key=len, reverse=True)) + ")")
    df = df.withColumn("_words", F.expr(f"CASE WHEN lower RLIKE {some} THEN {_words('lower')} ELSE CAST(array() AS array<string>) END"))
    df = df.withColumn("_places", F.expr(f"filter(transform(_words, (w, i) -> named_struct('i', i, 'w', w)), p -> array_contains({_array(firsts)}, p.w))"))
    none = "CAST(array() AS array<struct<label:string,containment:double>>)"
    each = []
    for k, (label, n, ranked, prefix, need, marks) in enumerate(tables):
        must = " AND ".join(f"array_contains(_words, {_q(w)})" for w in marks)
        places = f"filter(_places, p -> array_contains({_array(prefix)}, p.w))"
        blocks = f"filter(array_distinct(flatten(transform({places}, p -> array(p.i div {n}, p.i div {n} - 1)))), b -> b >= 0)"
        # the block's words that the template has, in the global order; the length filter looks at the block's own words
        shared = f"transform({blocks}, b -> array_intersect({_array(ranked)}, slice(_words, CAST(b * {n} + 1 AS INT), {2 * n})))"
        # behind the first shared word the template has so many words left, and no more of them can be shared
        first = f"array_position({_array(ranked)}, s[0])"
        passed = f"filter({shared}, s -> size(s) > 0 AND 1 + {len(ranked)} - {first} >= {need} AND size(s) >= {need}" + "".join(f" AND array_contains(s, {_q(w)})" for w in marks) + ")"
        found = f"transform({passed}, s -> named_struct('label', {_q(label)}, 'containment', CAST(size(s) AS DOUBLE) / {len(ranked)}))"
        df = df.withColumn(f"_found{k}", F.expr(f"CASE WHEN size(_words) >= {need} AND {must} THEN {found} ELSE {none} END"))
    names = [f"_found{k}" for k in range(len(tables))]
    return df.withColumn("found", F.expr(f"concat({', '.join(names)})")).drop("_words", "_places", *names)


def phrases(df: DataFrame, wanted=PHRASES) -> DataFrame:
    """Adds ``n_words`` and ``places``: (word, label) of every place where a phrase's words stand one behind the other."""
    df = df.withColumn("n_words", F.expr(f"size({_words('lower')})").cast("long"))
    each = []
    for i, (phrase, label) in enumerate(wanted):
        pattern = _q(rf"(?<=\A|{_BETWEEN})" + (_BETWEEN + "+").join(phrase.split()) + rf"(?={_BETWEEN}|\z)")
        there = " AND ".join(f"contains(lower, {_q(w)})" for w in phrase.split())
        n = len(phrase.split())
        # words before each place: those of the parts before it and of the phrases between
        steps = f"transform(slice(p, 1, size(p) - 1), x -> size({_words('x')}) + {n})"
        df = df.withColumn(f"_steps{i}", F.expr(f"CASE WHEN {there} THEN transform(array(split(lower, {pattern}, -1)), p -> {steps})[0] ELSE CAST(array() AS array<int>) END"))
        df = df.withColumn(f"_before{i}", F.expr(running(f"_steps{i}")))
        each.append(f"transform(_steps{i}, (x, k) -> named_struct('at', CAST(_before{i}[k] AS INT) + x - {n}, 'label', {_q(label)}))")
    return df.withColumn("places", F.expr(f"concat({', '.join(each)})")).drop(*(f"{c}{i}" for i in range(len(wanted)) for c in ("_steps", "_before")))


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns in ``keep``, ``lower``, ``n_words``, ``places`` and ``found``; a kept column of such a name is replaced."""
    results = ("lower", "n_words", "places", "found")
    rows = phrases(join_blocks(_lower(df, tuple(c for c in keep if c not in results), text), templates, threshold))
    return rows.select("_row.*", *results).drop("_none")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), keep=("doc_id",))
    joined = lambda expr: F.expr(f"array_join(array_sort(array_distinct({expr})), ',')")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.expr("array_min(transform(places, p -> p.at))").cast("long").alias("first_word"),
        F.expr("array_max(transform(places, p -> p.at))").cast("long").alias("last_word"),
        joined("transform(places, p -> p.label)").alias("base_labels"),
        joined("concat(transform(places, p -> p.label), transform(found, f -> f.label))").alias("labels"),
        F.coalesce(F.expr("array_max(transform(found, f -> f.containment))"), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    rows = ", ".join(f"('{label}', {n}, {words!r}, {marks!r})" for label, (n, words, marks) in template_words().items())
    word = WORD
    hits = " UNION ALL ".join(
        f"SELECT rid, '{label}' AS label, i - 1 AS pos FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM words) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(phrase.split()))
        for phrase, label in PHRASES
    )
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    words AS (SELECT rid, doc_id, regexp_extract_all(t, '{word}') AS w FROM docs),
    places AS ({hits}),
    base AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM places GROUP BY rid),
    templates(label, n, words, marks) AS (VALUES {rows}),
    blocks AS (SELECT rid, w, label, n, words, marks, unnest(range(0, len(w), n)) AS start FROM words, templates WHERE len(list_intersect(w, marks)) = len(marks)),
    sets AS (SELECT rid, label, words, marks, list_intersect(words, w[start + 1 : start + 2 * n]) AS s FROM blocks),
    found AS (SELECT rid, label, len(s) / len(words) AS containment FROM sets WHERE len(s) >= {THRESHOLD} * len(words) - 1e-9 AND len(list_intersect(s, marks)) = len(marks)),
    best AS (SELECT rid, max(containment) AS score FROM found GROUP BY rid),
    every AS (SELECT rid, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT rid, label FROM found UNION ALL SELECT rid, label FROM places) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM words LEFT JOIN base USING (rid) LEFT JOIN best USING (rid) LEFT JOIN every USING (rid)
    """


ORACLE = _oracle()
