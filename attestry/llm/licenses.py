"""License scans by an exact set-similarity join of text blocks with license templates.

Words are numbered in one global order, the rarest in the corpus first. A template of m distinct words is met by a
block, any run of as many words as the template's text has, that holds at least alpha = ceil(threshold * m) of
them, the words that tell it from its relatives among them. Such a block holds one of the template's m - alpha + 1 rarest
words (prefix filter); what stands before the first of these in it are none of them, so that enough others must
follow (positional filter); a text of fewer than alpha words has no such block (length filter). Only blocks in which such a
word comes first are formed, and each is intersected exactly. The templates are a parameter of a few texts, so their
index travels with the plan; no row of the corpus is shuffled but the word counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that carry a label wherever their words stand consecutively.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Texts of public licenses, in words, and those of their words that a block must hold.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
        "sublicense",
    ),
    "apache-2": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
        "express or implied see the license for the specific language governing permissions and limitations under the license",
        "compliance",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions",
    ),
    "gpl-2": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version",
        "gnu general 2",
    ),
    "gpl-3": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        "gnu general 3",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
        "fee appear",
    ),
}
Templates = dict[str, tuple[str, str]]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def vocabulary(templates: Templates) -> list[str]:
    return sorted({w for text, _ in templates.values() for w in text.split()})


def global_order(docs: DataFrame, templates: Templates) -> list[str]:
    """The templates' words, the rarest in the corpus first. The result has at most one row for each of them."""
    vocab = vocabulary(templates)
    found = docs.select(F.explode(F.filter(words(F.col("text")), lambda w: w.isin(vocab))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts = {r["w"]: r["n"] for r in found.collect()}
    return sorted(vocab, key=lambda w: (counts.get(w, 0), w))


def places(words_col: Column, phrase: str) -> Column:
    """Starts of the phrase; the words are only walked through where its rarest is among them."""
    parts = phrase.split()
    hit = lambda i: math_and([F.get(words_col, i + k) == w for k, w in enumerate(parts)])
    rare = max(parts, key=lambda w: (w in ("mit", "apache", "cc"), len(w)))
    return F.when(F.array_contains(words_col, rare), F.filter(F.sequence(F.lit(0), F.size(words_col)), hit)).otherwise(F.array().cast("array<int>"))


def math_and(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def sized(text: str, threshold: float) -> tuple[int, int, int]:
    """Words of a template, distinct ones, and how many of these a block must hold."""
    m = len(set(text.split()))
    return len(text.split()), m, math.ceil(threshold * m - 1e-9)


def prefix_words(text: str, order: list[str], threshold: float) -> list[str]:
    rank = {w: k for k, w in enumerate(order)}
    _, m, alpha = sized(text, threshold)
    return sorted(set(text.split()), key=rank.__getitem__)[: m - alpha + 1]


def best_block(w: Column, anchors: Column, text: str, must: str, order: list[str], threshold: float) -> Column:
    """Most template words in any block that meets the template, or null. anchors: struct<i, word> of the words of all prefixes."""
    length, m, alpha = sized(text, threshold)
    own = F.array(*map(F.lit, sorted(set(text.split()))))
    prefix = prefix_words(text, order, threshold)
    firsts = F.transform(F.filter(anchors, lambda a: a["word"].isin(prefix)), lambda a: a["i"])

    def starts(i: Column, k: Column) -> Column:
        """Starts, at template words, of the blocks whose first prefix word is the k-th, at i."""
        before = F.when(k > 0, F.get(firsts, k - 1)).otherwise(F.lit(-1))
        lo = F.greatest(before + 1, i - (length - 1))
        held = F.filter(F.sequence(lo, i), lambda s: F.array_contains(own, F.get(w, s)))
        return F.filter(held, lambda s: F.least(i - s, F.lit(alpha - 1)) + F.least(s + length, F.size(w)) - i >= alpha)

    def held(s: Column) -> Column:
        block = F.array_intersect(F.slice(w, s + 1, F.lit(length)), own)
        return F.when(math_and([F.array_contains(block, x) for x in must.split()]) & (F.size(block) >= alpha), F.size(block))

    return F.when(F.size(w) >= alpha, F.array_max(F.flatten(F.transform(firsts, lambda i, k: F.transform(starts(i, k), held)))))


def scan_licenses(docs: DataFrame, templates: Templates = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Null and empty texts, and those of an empty table, have no words, no labels and score 0. Repeated rows give repeated
    rows. Texts of any length are taken whole; equal scores need no order, for all labels met are listed.
    score: 1 where a base phrase stands, else the largest share of a template that meets the threshold, else 0.
    Other columns are ignored, so their names cannot clash."""
    docs = texts(docs, id_col, text_col)
    order = global_order(docs, templates)
    rare = sorted({w for text, _ in templates.values() for w in prefix_words(text, order, threshold)})
    # explode of one element: what is made once is used often
    once = lambda df, keep, **columns: df.select(*keep, F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("_")).select(*keep, "_.*")
    cut = once(docs, ["doc_id"], words=words(F.col("text")))
    w = F.col("words")
    anchors = F.filter(F.transform(w, lambda x, i: F.when(x.isin(rare), F.struct(i.alias("i"), x.alias("word")))), lambda a: a.isNotNull())
    cut = once(cut, ["doc_id", "words"], n_words=F.size(w).cast("long"), anchors=anchors, **{f"p{k}": places(w, p) for k, p in enumerate(PHRASES)})
    met = [F.when(F.size("anchors") > 0, best_block(w, F.col("anchors"), text, must, order, threshold)) / sized(text, threshold)[1] for text, must in templates.values()]
    starts = F.concat(*(F.col(f"p{k}") for k in range(len(PHRASES))))
    base = F.filter(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))), lambda x: x.isNotNull())
    cut = once(cut, ["doc_id", "n_words"], starts=starts, base=F.array_sort(F.array_distinct(base)), met=F.array(*met) if met else F.array().cast("array<double>"))
    found = F.filter(F.array(*(F.when(F.get("met", F.lit(k)).isNotNull(), F.lit(label)) for k, label in enumerate(templates))), lambda x: x.isNotNull()) if met else F.array().cast("array<string>")
    return cut.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", found)), ",").alias("labels"),
        F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce(F.array_max("met"), F.lit(0.0))).alias("score"),
    )


def oracle(templates: Templates = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result in DuckDB: all blocks that begin with a template word, without any filter."""
    rows = [(label, w, w in must.split(), *sized(text, threshold)) for label, (text, must) in templates.items() for w in sorted(set(text.split()))]
    values = ", ".join(f"('{a}', '{w}', {'true' if must else 'false'}, {length}, {m}, {alpha})" for a, w, must, length, m, alpha in rows)
    leads = ", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(1, 4))
    hits = " UNION ALL ".join(f"SELECT doc_id, i AS place, '{label}' AS label FROM l WHERE " + " AND ".join(f"{'word' if not k else f'w{k}'} = '{x}'" for k, x in enumerate(p.split())) for p, label in PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
l AS (SELECT *, {leads} FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hits AS ({hits}),
t(label, word, must, length, m, alpha) AS (VALUES {values}),
h AS (SELECT doc_id, i, w.word, label, must, length, m, alpha FROM w JOIN t ON w.word = t.word),
met AS (SELECT a.doc_id, a.label, count(DISTINCT b.word) / max(a.m) AS share FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.label = b.label AND b.i BETWEEN a.i AND a.i + a.length - 1
  GROUP BY a.doc_id, a.label, a.i HAVING count(DISTINCT b.word) >= max(a.alpha) AND count(DISTINCT CASE WHEN b.must THEN b.word END) = (SELECT count(*) FROM t WHERE t.label = a.label AND t.must)),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM met UNION ALL SELECT doc_id, label FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN named USING (doc_id)"""
