"""Licence scan by a positional index of rare words.

1. Every text is one array of words; ``occurrences`` keeps the places of words that licence templates
   use, and the number of words: a few numbers per text that has any. Words common in prose are kept only
   within ``NEAR`` places of another word of the vocabulary, as far as key phrases use them.
2. The document frequencies of the vocabulary, over all texts, give its IDF. Each template is indexed
   under the two rarest words of its mandatory key phrase, so no text that has the phrase can be missed.
   Every place of the rarest word, less its position in the template, is a start where the template may
   stand; it is kept if the second word stands at its own relative position.
3. Such starts are verified on the occurrences around them: the whole key phrase in place, common words
   included, gives the label, however much of the notice around it stands there; the share of the
   template's words found in place is the score.

The index (templates, postings) is a constant of the program. All steps are expressions of one row but
the document frequencies, which are counted map-side to at most one row per template word and task: no
shuffle of texts, whatever source or group of copies is hot.

Base labels come from phrases whose words stand consecutively anywhere, apart from templates.

Defined results: NULL text is empty (no words, no labels, score 0); repeated rows are scanned alike; a
NULL ``doc_id`` is carried; empty tables give empty results; other columns are not read. Templates and
phrases have no letter k: the one letter outside A-Z that lower() turns into an ASCII letter (the Kelvin
sign) cannot make or unmake a word of theirs, so lower() serves for A-Z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, stored, text_of

#: Everything ASCII but a-z and 0-9 separates words (after lowering A-Z).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels; fixed values.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Label, template, mandatory key phrase. Wordings of the public licence notices; fixed values.
TEMPLATES = (
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "terms of the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "terms of the gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("mit-reference", "released under the mit license", "the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "use copy modify and or distribute this software"),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license", "free software foundation either version 3 of the license"),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2 of the license", "free software foundation either version 2 of the license"),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
)
#: Words too common in prose to be worth a place in the index, unless a base phrase needs them.
COMMON = frozenset("a and any are as at be by for from in into is may no of or the this to use will with without you".split())
#: How far a common word of a key phrase is from a word of the vocabulary in the same phrase, at most.
NEAR = 2


def _vocabulary() -> list[str]:
    words = {w for p, _ in PHRASES for w in p.split()} | {w for _, t, _ in TEMPLATES for w in t.split()}
    mandatory = {w for p, _ in PHRASES for w in p.split()}
    return sorted(w for w in words if w in mandatory or w not in COMMON)


VOCABULARY = _vocabulary()


#: Common words that key phrases need.
CONNECTING = sorted({w for _, _, k in TEMPLATES for w in k.split()} - set(VOCABULARY))


def places(text: str, key: str) -> list[tuple[int, str, bool]]:
    """Position, word, and whether the key phrase holds it: all words of the key phrase and the words of
    the vocabulary around it."""
    words, inside = text.split(), key.split()
    at = next(i for i in range(len(words)) if words[i : i + len(inside)] == inside)
    keyed = range(at, at + len(inside))
    return [(i, w, i in keyed) for i, w in enumerate(words) if i in keyed or w in VOCABULARY]


def _entries(places: list[tuple[int, str]]) -> str:
    return "array(" + ", ".join(f"struct({p} AS p, '{w}' AS w)" for p, w in places) + ")"


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, hits: array of (pos, w) of the words in the vocabulary and, next to them, of the
    common words of key phrases."""
    require(docs, "doc_id", "text")
    parts = F.split(F.lower(text_of()), SEPARATORS, -1)
    # a separator at the start leaves one empty part there, one at the end leaves one there
    rows = docs.select("doc_id", parts.alias("parts"))
    rows = rows.withColumn("skip", F.when(F.get("parts", F.lit(0)) == "", 1).otherwise(0))
    rows = rows.withColumn("empty_end", F.when((F.size("parts") > 1) & (F.element_at("parts", -1) == ""), 1).otherwise(0))
    vocabulary, connecting = (", ".join("'" + w + "'" for w in words) for words in (VOCABULARY, CONNECTING))
    near = " OR ".join(f"get(parts, i {d:+d}) IN ({vocabulary})" for d in range(-NEAR, NEAR + 1) if d)
    return rows.select(
        "doc_id", (F.size("parts") - F.col("skip") - F.col("empty_end")).cast("long").alias("n_words"),
        F.expr(f"filter(transform(parts, (w, i) -> CASE WHEN w IN ({vocabulary}) OR w IN ({connecting}) AND ({near}) THEN struct(i - skip AS pos, w AS w) END), x -> x IS NOT NULL)").alias("hits"),
    )


def inverse_frequencies(hits: DataFrame) -> dict[str, float]:
    """IDF of every vocabulary word over all texts: at most one row per word reaches the driver."""
    import math

    total = hits.count()
    words = hits.where(F.size("hits") > 0).select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("w"))
    words = words.where(F.col("w").isin(VOCABULARY))
    found = {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((1 + total) / (1 + found.get(w, 0))) for w in VOCABULARY}


def scan(hits: DataFrame, idf: dict[str, float]) -> DataFrame:
    """doc_id, n_words, starts of base phrases, base labels, template matches, score."""
    # consecutive words are read off the sorted hits: the k-th next hit is k words on exactly if the
    # phrase stands there, as all its words are hits
    rows = hits
    for i, (phrase, _) in enumerate(PHRASES):
        words = phrase.split()
        held = " AND ".join(f"get(hits, k + {j}).w = '{w}' AND get(hits, k + {j}).pos = x.pos + {j}" for j, w in enumerate(words) if j)
        rows = rows.withColumn(f"base_{i}", F.expr(f"transform(filter(transform(hits, (x, k) -> struct(x.pos AS pos, x.w = '{words[0]}' AND {held} AS held)), y -> coalesce(y.held, false)), y -> y.pos)"))
    postings: dict[str, list[str]] = {}
    contents, required = [], []
    for t, (_, text, key) in enumerate(TEMPLATES):
        all_places = [(i, w) for i, w, _ in places(text, key)]
        keyed = [(i, w) for i, w, in_key in places(text, key) if in_key]
        (p, w), (p2, w2) = sorted(((i, w) for i, w in keyed if w in idf), key=lambda x: (-idf[x[1]], x[1]))[:2]
        postings.setdefault(w, []).append(f"struct({t} AS t, {p} AS p, '{w2}' AS w2, {p2} AS p2)")
        contents.append(f"{t}, {_entries(all_places)}")
        required.append(f"{t}, {_entries(keyed)}")
    index = "map(" + ", ".join(f"'{w}', array({', '.join(e)})" for w, e in sorted(postings.items())) + ")"
    looked_up = ", ".join(f"'{w}'" for w in sorted(postings))
    reach = max(len(t.split()) for _, t, _ in TEMPLATES)
    around = f"slice(hits, greatest(k - {reach}, 0) + 1, {2 * reach + 1})"  # hits are words, so a template's are within its length
    rows = rows.withColumn("starts", F.expr(f"""flatten(transform(hits, (x, k) -> CASE WHEN x.w IN ({looked_up}) THEN
        filter(transform(element_at({index}, x.w), q -> struct(q.t AS t, x.pos - q.p AS s, q.w2 AS w2, q.p2 AS p2, {around} AS near)),
               q -> exists(q.near, h -> h.w = q.w2 AND h.pos = q.s + q.p2)) ELSE array() END))"""))
    near = "transform(c.near, h -> struct(h.pos - c.s AS p, h.w AS w))"
    rows = rows.withColumn("matches", F.expr(f"""array_distinct(filter(transform(starts, c -> struct(c.t AS t, c.s AS s,
        size(array_intersect(element_at(map({', '.join(contents)}), c.t), {near})) / size(element_at(map({', '.join(contents)}), c.t)) AS share,
        size(array_except(element_at(map({', '.join(required)}), c.t), {near})) = 0 AS keyed)), m -> m.keyed))"""))
    return rows.select("doc_id", "n_words", *[f"base_{i}" for i in range(len(PHRASES))], "matches")


def _joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(labels)), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, matches, score."""
    hits = stored(occurrences(docs), "licence-hits")
    rows = scan(hits, inverse_frequencies(hits))
    base = [F.col(f"base_{i}") for i in range(len(PHRASES))]
    places = F.concat(*base)
    named = F.filter(F.array(*[F.when(F.size(b) > 0, F.lit(label)) for b, (_, label) in zip(base, PHRASES, strict=True)]), lambda x: x.isNotNull())
    own = F.transform("matches", lambda m: F.element_at(F.array(*[F.lit(label) for label, _, _ in TEMPLATES]), m["t"] + 1))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    score = F.greatest(best, F.when(F.size(places) > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        _joined(named).alias("base_labels"), _joined(F.concat(named, own)).alias("labels"), "matches", score.cast("double").alias("score"),
    )
