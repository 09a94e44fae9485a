"""Fixtures with the awkward rows every operator must take, and plain Python versions."""

import random
import re

WORDS = [w + v for w in ("stone", "river", "cloud", "green", "paper", "light", "north", "sugar") for v in ("", "ed", "ing", "er", "ly")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice([".", ","]) if rng.random() < 0.1 else "") for _ in range(n))


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source); with extra columns whose names operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 7, "y") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, words string, size int, removed string")


def awkward(seed=0):
    """NULL and empty texts, blanks only, NULL id, repeated rows, a very long text, ties."""
    rng = random.Random(seed)
    same = prose(rng, 40)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", None), (None, prose(rng, 30), "b"), (4, same, "b"), (4, same, "b"), (5, same, "c"),
        (6, prose(rng, 20_000), "c"), (7, "ünï cödé 日本語 🙂 É", "ñ"), (8, prose(rng, 12) + "\n" + prose(rng, 12), None), (9, "x", "a"),
    ]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]
