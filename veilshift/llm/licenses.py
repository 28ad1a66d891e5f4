"""License scans: base phrases, and an exact set-similarity join of text blocks with notice templates.

DataFrame functions only. A first pass counts how often the templates' tokens occur in the corpus; that fixed
vocabulary gets a global order, rare tokens first. A block (a sentence or line) joins a template if it holds at least
THRESHOLD of the template's distinct tokens. With both in the global order, a block that does shares a token of the
template's prefix (prefix filter), has enough tokens of the vocabulary (length filter), and enough of them can still
follow its first common token (positional filter); what passes is verified on the whole sets, once, at the first common
token. The templates are a small table, so its inverted index of prefix tokens travels as one literal map that a block's
tokens are looked up in: a hash join without a shuffle, whose work doesn't grow with templates that share no token.

A notice may be wrapped: a sentence over several lines is also looked at in overlapping runs of words, long enough for
the longest template to lie inside one wherever its lines end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, documents

#: Words of a text whose A-Z are in lower case, and the same words in a text as it is.
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Where blocks end.
BLOCK_END = r"[.!?][\x09-\x0D\x20]|\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where sentences end that may run over several lines.
SENTENCE_END = r"[.!?][\x09-\x0D\x20]|\n[\x09\x0B-\x0D\x20]*\n"
THRESHOLD = 0.9

#: Fixed phrases of the base rule and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Fixed notices and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "released into the public domain under cc0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def vocabulary() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in t.split()})


def rare_first(docs: DataFrame, text_col: str) -> list[str]:
    """The templates' tokens by how often they occur in all texts, rare ones first. At most the vocabulary's rows come to the driver."""
    known = vocabulary()
    of = docs.select(F.explode(words(lowered(F.col(text_col).cast("string")), LOWER_WORD)).alias("w")).filter(F.col("w").isin(known))
    counts = {r.w: r.c for r in of.groupBy("w").agg(F.count("*").alias("c")).collect()}
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def _least(size: int, threshold: float) -> int:
    k = int(size * threshold)
    return k if k >= size * threshold else k + 1


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def prefix_index(order: list[str], threshold: float, templates=TEMPLATES) -> Column:
    """The table of templates as an inverted index: each token of some template's prefix, and the templates with it there:
    (label, tokens in the global order, n, least: tokens that a block needs). A literal, as large as the templates' prefixes."""
    place = {w: i for i, w in enumerate(order)}
    by_token: dict[str, list[Column]] = {}
    for label, text in templates:
        tokens = sorted(set(text.split()), key=place.__getitem__)
        n, least = len(tokens), _least(len(tokens), threshold)
        entry = F.struct(F.lit(label).alias("label"), _array(tokens).alias("tokens"), F.lit(n).alias("n"), F.lit(least).alias("least"))
        for t in tokens[: n - least + 1]:
            by_token.setdefault(t, []).append(entry)
    return F.create_map(*[x for t, entries in sorted(by_token.items()) for x in (F.lit(t), F.array(*entries))])


def _matches(block: Column, index: Column) -> Column:
    """(label, containment) of the templates that a block joins; block: its tokens of the vocabulary in the global order.
    Its tokens look up the templates whose prefixes hold them; a template is judged at the first of those alone."""
    empty = F.array().cast("array<struct<label:string,part:double>>")

    def of(token: Column, at: Column) -> Column:
        def judge(t: Column) -> Column:
            # length and prefix filters, first common token, positional filter, then the whole sets
            size, needed = F.size(block), t["least"]
            place = F.array_position(t["tokens"], token)
            first = F.get(F.array_intersect(block, F.slice(t["tokens"], 1, t["n"] - needed + 1)), F.lit(0)) == token
            follow = 1 + F.least(t["n"] - place, size - at - 1)
            return (size >= needed) & (at <= size - needed) & (follow >= needed) & first & (F.size(F.array_intersect(block, t["tokens"])) >= needed)

        found = F.filter(F.element_at(index, token), judge)
        return F.coalesce(F.transform(found, lambda t: F.struct(t["label"].alias("label"), (F.size(F.array_intersect(block, t["tokens"])).cast("double") / t["n"]).alias("part"))), empty)

    return F.flatten(F.transform(block, of))


def scan(docs: DataFrame, carry: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: the columns of carry, and

    li_words (number of words), li_places: array of (label, at) of base phrases in order, li_matches: array of
    (label, part) of the blocks that join a template.

    Null text: as the empty one. Repeated rows: alike. No rows: no rows. Other columns go, and so does a column of carry
    that has one of the names above.
    """
    carry = [c for c in carry if c not in ("li_words", "li_places", "li_matches")]
    order = rare_first(docs, text_col)
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.lit(0).alias("none"), *[column(c).alias(f"c{k}") for k, c in enumerate(carry)]).alias("li_row"), text.alias("li_text"))
    none = F.array().cast("array<struct<label:string,at:bigint>>")

    def places(w: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            label = F.lit(None).cast("string")
            for phrase, name in PHRASES:
                first, *rest = phrase.split()
                hit = x == first
                for k, word in enumerate(rest, 1):
                    hit = hit & F.coalesce(F.get(w, i + k) == word, F.lit(False))
                label = F.when(hit, F.lit(name)).otherwise(label)
            return F.struct(label.alias("label"), i.cast("bigint").alias("at"))

        return F.filter(F.transform(w, at), lambda p: p["label"].isNotNull())

    found = F.when(F.col("li_text").rlike("(?i)license"), let(words(lowered(F.col("li_text")), LOWER_WORD), places)).otherwise(none)

    # a block that joins has a token of some template's prefix: only those blocks are looked at
    place = {w: i for i, w in enumerate(order)}
    signs = sorted({t for _, x in TEMPLATES for t in sorted(set(x.split()), key=place.__getitem__)[: len(set(x.split())) - _least(len(set(x.split())), threshold) + 1]})
    sign = f"(?i)(?<![a-z0-9])(?:{'|'.join(signs)})(?![a-z0-9])"

    def block(b: Column) -> Column:
        return let(words(lowered(b), LOWER_WORD), lambda w: F.filter(_array(order), lambda v: F.array_contains(w, v)))

    blocks = F.filter(F.split("li_text", BLOCK_END, -1), lambda b: b.rlike(sign))
    longest = max(len(x.split()) for _, x in TEMPLATES)

    def runs(b: Column) -> Column:
        def cut(w: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - longest, F.lit(0)), F.lit(longest)), lambda i: F.slice(w, i + 1, 2 * longest))

        return let(words(lowered(b), LOWER_WORD), cut)

    wrapped = F.filter(F.split("li_text", SENTENCE_END, -1), lambda b: b.contains("\n") & b.rlike(sign))
    wrapped = F.transform(F.flatten(F.transform(wrapped, runs)), lambda w: F.filter(_array(order), lambda v: F.array_contains(w, v)))
    every = F.concat(F.transform(blocks, block), wrapped)
    index = prefix_index(order, threshold)
    matches = F.when(F.col("li_text").rlike(sign), F.flatten(F.transform(every, lambda b: _matches(b, index))))
    matches = F.coalesce(matches, F.array().cast("array<struct<label:string,part:double>>"))
    return rows.select(*[F.col("li_row").getField(f"c{k}").alias(c) for k, c in enumerate(carry)], F.size(words(F.col("li_text"), ANY_WORD)).cast("bigint").alias("li_words"), found.alias("li_places"), matches.alias("li_matches"))


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    """score: 1 where a base phrase stands, else the largest part of a template that a block holds, else 0."""
    s = scan(documents(spark, sf_dir), ["doc_id"])
    base = F.transform("li_places", lambda p: p["label"])
    both = F.concat(base, F.transform("li_matches", lambda m: m["label"]))
    at = F.transform("li_places", lambda p: p["at"])
    return s.select(
        "doc_id", F.col("li_words").alias("n_words"), F.size("li_places").cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(both)), ",").alias("labels"),
        F.when(F.size("li_places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("li_matches", lambda m: m["part"])), F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    longest = max(len(x.split()) for _, x in TEMPLATES)
    known = "[" + ", ".join(f"{{'label': '{a}', 'tokens': [{', '.join(repr(w) for w in sorted(set(t.split())))}]}}" for a, t in TEMPLATES) + "]"
    hit = " OR ".join("(" + " AND ".join(f"w[i{f' + {k}' if k else ''}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p, _ in PHRASES)
    label = "CASE " + " ".join(f"WHEN {' AND '.join(f'w[i{f" + {k}" if k else ""}] = {x!r}' for k, x in enumerate(p.split()))} THEN '{name}'" for p, name in PHRASES) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{LOWER_WORD}') AS w FROM d),
p AS (SELECT r, doc_id, t, w, list_filter(range(1, len(w) + 1), lambda i: {hit}) AS pos FROM w),
s AS (SELECT r, regexp_extract_all(b, '{LOWER_WORD}') AS w FROM (SELECT r, unnest(regexp_split_to_array(t, '{SENTENCE_END}')) AS b FROM d) WHERE contains(b, chr(10))),
b AS (
  SELECT r, regexp_extract_all(b, '{LOWER_WORD}') AS w FROM (SELECT r, unnest(regexp_split_to_array(t, '{BLOCK_END}')) AS b FROM d)
  UNION ALL SELECT r, w[i + 1:i + {2 * longest}] FROM (SELECT r, w, unnest(range(0, greatest(len(w) - {longest}, 0) + 1, {longest})) AS i FROM s)),
m AS (
  SELECT r, k.label AS label, len(list_intersect(k.tokens, w))::double / len(k.tokens) AS part
  FROM (SELECT r, w, unnest({known}) AS k FROM b)
  WHERE len(list_intersect(k.tokens, w)) >= {THRESHOLD}::double * len(k.tokens)),
g AS (SELECT r, list(label) AS labels, max(part) AS part FROM m GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, len(pos)::bigint AS n_base, (list_min(pos) - 1)::bigint AS first_word, (list_max(pos) - 1)::bigint AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(pos, lambda i: {label}))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(pos, lambda i: {label}), coalesce(labels, [])))), ',') AS labels,
       CASE WHEN len(pos) > 0 THEN 1.0::double ELSE coalesce(part, 0.0::double) END AS score
FROM p LEFT JOIN g USING (r)
"""


SQL = _sql()
