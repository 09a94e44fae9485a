import random
import re

import numpy as np
import xxhash
from helpers import awkward, components, documents, prose, words
from pyspark.sql import functions as F

from isochrone.llm import line_dedup, simhash
from isochrone.llm.components import connected_components


def test_components_equal_union_find(spark):
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 470)] + [(500, i) for i in range(501, 700)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    want = components(700, links)
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def grams(text):
    return {text[i : i + 5] for i in range(max(1, len(text) - 4))}


def near(a, b):
    x, y = grams(a), grams(b)
    return 10 * len(x & y) >= 8 * len(x | y)


def brute_removed(rows):
    """Per (id, text): the line numbers to go, by comparing all pairs of lines."""
    spots = []
    for doc_id, text in dict.fromkeys((r[0], r[1] or "") for r in rows):
        for n, line in enumerate(text.split("\n")):
            norm = " ".join(words(line))
            if norm:
                spots.append((doc_id, text, n, norm))
    norms = sorted({s[3] for s in spots})
    at = {x: i for i, x in enumerate(norms)}
    comp = components(len(norms), [(i, j) for i in range(len(norms)) for j in range(i) if near(norms[i], norms[j])])
    first, gone = {}, {}
    for doc_id, text, n, norm in sorted(spots, key=lambda s: (s[0] is None, s[0] or 0, s[2])):
        c = comp[at[norm]]
        gone.setdefault((doc_id, text), [])
        if c in first:
            gone[(doc_id, text)].append(n)
        first.setdefault(c, 1)
    return gone


def edited(rng, line, edits):
    w = line.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice("abcdefgh") * 3
    return " ".join(w)


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    base = [prose(rng, rng.randint(8, 30)) for _ in range(25)]
    rows = [r[:2] for r in awkward() if r[0] != 6]
    for i in range(60):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 1, 1, 2])) if rng.random() < 0.6 else prose(rng, rng.randint(1, 25)) for _ in range(4)]
        rows.append((100 + i, "\n".join(lines + ["", "  " + lines[0].replace(" ", "\t")])))
    got = line_dedup.removed_lines(documents(spark, rows)).select("doc_id", F.col("removed")).collect()
    want = brute_removed(rows)
    lines = sum(len(v) for v in want.values())
    assert sum(len(r["removed"]) for r in got) >= 0.98 * lines  # banding may miss a pair at the threshold
    by_id = {k[0]: set(v) for k, v in want.items()}
    for r in got:
        assert set(r["removed"]) <= by_id[r["doc_id"]] or r["doc_id"] < 100


def test_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(8)
    line = prose(rng, 40)
    rows = [(i, edited(rng, line, 1)) for i in range(400)] + [(1000 + i, prose(rng, 40)) for i in range(50)]
    docs = documents(spark, rows)
    out = line_dedup.dedup_lines(docs)
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == docs.columns
    assert {i for i in kept if i >= 1000} == set(range(1000, 1050)) and len([i for i in kept if i < 1000]) == 1


def test_dedup_lines_rebuilds_texts(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 20) for _ in range(3))
    rows = [(1, f"{a}\n\n{b}\n{a}"), (2, f"{b}\n{c}"), (3, a), (4, None), (5, " \n"), (None, c), (6, c + "\nshort")]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: (f"{a}\n\n{b}", len(a) + len(b) + 2), 2: (c, len(c)), 4: (None, 0), 5: (" \n", 2), 6: ("short", 5)}
    assert line_dedup.dedup_lines(documents(spark, rows).limit(0)).count() == 0


def brute_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, 300) for _ in range(12)]
    rows = awkward() + [(100 + i, edited(rng, rng.choice(base), rng.choice([0, 1, 2]))) for i in range(150)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    ids, points = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    comp = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (points[i] ^ points[j]).bit_count() <= 2])
    least = {}
    for i, c in enumerate(comp):
        if ids[i] is not None:
            least[c] = min(least.get(c, ids[i]), ids[i])
    want = sorted(((ids[i] is None, ids[i] or 0, points[i], least.get(comp[i])) for i in range(len(rows))), key=str)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % 2**64, r["component_id"]) for r in got), key=str) == want
    out = simhash.unique_documents(documents(spark, rows))
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(x) for x in {least.get(c) for c in comp})
    assert simhash.near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_trees_find_every_link():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 2**63, 4000, dtype="uint64")
    flip = lambda x, k: np.bitwise_xor.reduce([x, *(np.uint64(1) << rng.integers(0, 63, len(x), dtype="uint64") for _ in range(k))])
    p = np.unique(np.concatenate([p, flip(p[:400], 1), flip(p[:400], 2), flip(np.repeat(p[:1], 2500), 3)]))
    full = [(i, i + 1 + int(j)) for i in range(len(p) - 1) for j in np.flatnonzero(simhash.distance(p[i + 1 :], p[i]) <= 2)]
    want = components(len(p), full)
    assert components(len(p), simhash.shard_links(p, 2)) == want
    where, shard = simhash.route(simhash.routing_tree(p[::5], 16), p, 2)
    links = []
    for s in np.unique(shard):
        own = where[shard == s]
        links += [(int(own[a]), int(own[b])) for a, b in simhash.shard_links(p[own], 2)]
    assert len(np.unique(shard)) > 4 and components(len(p), links) == want


def test_anchored_shingles_cover_long_runs(spark):
    rng = random.Random(11)
    run = "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏") for _ in range(120))
    rows = [(1, run), (2, run[:60] + "X" + run[60:]), (3, re.sub(".", "z", run[:40]))]
    got = {r["doc_id"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1, 3}


def test_unique_documents_without_or_with_repeated_ids(spark):
    rng = random.Random(12)
    texts = [prose(rng, 60) for _ in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[5]), (None, texts[5]), (6, texts[5])]
    got = sorted((str(r["doc_id"]), r["text"]) for r in simhash.unique_documents(documents(spark, rows)).collect())
    assert got == sorted([("None", texts[0]), ("None", texts[1]), ("None", texts[2]), ("7", texts[3]), ("7", texts[4]), ("6", texts[5])])


def test_line_candidates_by_length(spark):
    rng = random.Random(13)
    pairs = [("Introduction", "(Introduction"), ("All rights reserved to us", "All rights reserved to us.")]
    for size in (12, 20, 40, 80, 200):
        while sum(len(p[0]) // 10 == size // 10 for p in pairs) < 100:
            a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(size)).strip()
            a = " ".join(a.split())
            b = rng.choice([a + rng.choice(".;!"), rng.choice("(-*") + a, a + " et", a[:-1] + "Q"])
            if near(a, b):
                pairs.append((a, b))
    left, right = (line_dedup.sketch([p[side] for p in pairs])[1] for side in (0, 1))
    found = {i for i in range(len(pairs)) if (left[i] == right[i]).any()}
    assert {0, 1} <= found
    for size in (1, 2, 4, 8, 20):
        own = [i for i, p in enumerate(pairs) if len(p[0]) // 10 == size]
        assert len(own) >= 50 and len(found & set(own)) >= 0.98 * len(own), size


def test_minima_bits_allow_every_near_pair(spark):
    rng = random.Random(14)
    pairs = []
    while len(pairs) < 400:
        a = " ".join(prose(rng, rng.randint(3, 60)).split())
        b = edited(rng, a, 1)
        if near(a, b):
            pairs.append((a, b))
    sides = [line_dedup.sketch([p[side] for p in pairs]) for side in (0, 1)]
    rows = [(i, sides[0][2][i].tolist(), sides[1][2][i].tolist()) for i in range(len(pairs))]
    got = spark.createDataFrame(rows, "i int, x array<long>, y array<long>").select(line_dedup.agreeing("x", "y").alias("n"), line_dedup.agreeing("x", "x").alias("own")).collect()
    nibbles = lambda v: [v % 2**64 >> 4 * i & 15 for i in range(16)]
    want = [sum(a == b for u, v in zip(r[1], r[2], strict=True) for a, b in zip(nibbles(u), nibbles(v), strict=True)) for r in rows]
    # places beyond the last minimum are always equal
    assert [r["n"] for r in got] == [w - 64 + line_dedup.BANDS * line_dedup.ROWS for w in want] and {r["own"] for r in got} == {line_dedup.BANDS * line_dedup.ROWS}
    assert sum(r["n"] < line_dedup.LEAST_AGREEING for r in got) <= 1
    for side in (0, 1):
        assert sides[side][0].tolist() == [len(grams(p[side])) for p in pairs]


def test_large_buckets_are_paired_by_rare_runs(spark, monkeypatch):
    """Lines that are alike but not near-equal, with a few links hidden among them."""
    monkeypatch.setattr(line_dedup, "SMALL_BUCKET", 4)
    rng = random.Random(15)
    base = prose(rng, 30)
    lines = [base + " " + "".join(rng.choice("abcdefghijklmnop ") for _ in range(110)) for _ in range(60)]
    lines += [x[:-6] + "zzzzzz" for x in lines[:20]]
    rows = [(i, x) for i, x in enumerate(lines)]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(documents(spark, rows)).collect()}
    want = {k[0]: v for k, v in brute_removed(rows).items()}
    assert got == want and sum(map(bool, want.values())) == 20


def test_texts_of_with_a_full_and_a_wide_bitmap(spark, monkeypatch):
    rng = random.Random(16)
    lines = [prose(rng, 12) for _ in range(200)]
    docs = documents(spark, [(i, "\n".join(lines[i : i + 20])) for i in range(0, 200, 10)])
    key = F.unhex(F.md5("norm"))
    asked = spark.createDataFrame([(x,) for x in lines[::7]], "norm string").select(key.alias("key")).select(line_dedup.node_of().alias("node"))
    for bits in (64, 1 << 16):
        monkeypatch.setattr(line_dedup, "FILTER_BITS", bits)
        got = line_dedup.texts_of(docs, asked).select("norm", (F.col("key") == key).alias("same")).collect()
        assert sorted(r["norm"] for r in got) == sorted(lines[::7]) and all(r["same"] for r in got)


def test_rarest_runs_are_few_and_shared_by_near_lines(spark):
    rng = random.Random(17)
    pairs = []
    while len(pairs) < 150:
        a = " ".join(prose(rng, rng.randint(6, 60)).split())
        b = edited(rng, a, rng.choice([1, 2]))
        if a != b and near(a, b):
            pairs.append((a, b))
    texts = spark.createDataFrame([(2 * i + j, x) for i, p in enumerate(pairs) for j, x in enumerate(p)], "node long, norm string")
    own = {}
    for r in line_dedup.rarest_runs(texts).collect():
        own.setdefault(r["node"], set()).add(r["element"])
    assert all(own.get(2 * i, set()) & own.get(2 * i + 1, set()) for i in range(len(pairs)))
    runs = {2 * i + j: len(grams(x)) for i, p in enumerate(pairs) for j, x in enumerate(p)}
    assert all(len(own.get(k, ())) <= n // 5 + 1 for k, n in runs.items())


def test_shuffle_files_go_with_their_step(spark):
    import time

    from isochrone.llm.common import CLEAN_UP, stored

    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {x for x in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before, was = files(), spark.conf.get(CLEAN_UP, None)
    table = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "step")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 7 and spark.conf.get(CLEAN_UP, None) == was


def test_lines_with_a_common_passage_cost_no_pairs(spark, monkeypatch):
    """1,200 lines that have a passage of half their length in common, not near-equal but for 40 pairs hidden among them."""
    rng = random.Random(18)
    passage = prose(rng, 30)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    lines = [f"{noise(len(passage) // 2)} {passage} {noise(len(passage) // 2)}" for _ in range(1200)]
    lines += [x[:-6] + "zzzzzz" for x in lines[:40]]
    rows, kept = {}, line_dedup.stored

    def counting(df, name, into=None):
        out = kept(df, name, into)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "stored", counting)
    got = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(documents(spark, list(enumerate(lines)))).collect()}
    assert {k for k, v in got.items() if v} == set(range(1200, 1240))
    # a line has 13 buckets; all pairs of the passage would be 768,800
    assert max(rows.values()) <= 13 * len(lines), rows


def test_signs_allow_what_is_near(spark):
    rng = random.Random(19)
    pairs = []
    while len(pairs) < 400:
        a = " ".join(prose(rng, rng.randint(3, 60)).split())
        b = edited(rng, a, 1)
        if near(a, b):
            pairs.append((a, b))
    sides = [line_dedup.sketch([p[side] for p in pairs]) for side in (0, 1)]
    sides = [line_dedup.signs(x[0], x[2]).tolist() for x in sides]
    other = spark.createDataFrame([(sides[0][i], sides[1][i], sides[1][i - 1]) for i in range(len(pairs))], "x long, y long, z long")
    got = other.select(line_dedup.signs_allow("x", "y").alias("near"), line_dedup.signs_allow("x", "x").alias("own"), line_dedup.signs_allow("x", "z").alias("far")).collect()
    assert sum(r["near"] for r in got) >= 399 and all(r["own"] for r in got) and sum(r["far"] for r in got) <= 20


def test_pairs_are_compared_in_turns(spark, monkeypatch):
    rng = random.Random(20)
    line = prose(rng, 40)
    docs = documents(spark, [(i, edited(rng, line, 2)) for i in range(30)])
    texts = sorted({" ".join(r["text"].split()) for r in docs.collect()})
    names = spark.createDataFrame([(x,) for x in texts], "norm string").select("norm", F.unhex(F.md5("norm")).alias("key")).select("norm", line_dedup.node_of().alias("node"))
    at = {r["node"]: r["norm"] for r in names.collect()}
    pairs = [(a, b) for a in at for b in at if a > b]
    monkeypatch.setattr(line_dedup, "PAIRS_A_TEXT", 6)
    used = []
    got = line_dedup.verified(docs, spark.createDataFrame(pairs, "a long, b long"), "turns", used)
    assert {(r["a"], r["b"]) for r in got.collect()} == {p for p in pairs if near(at[p[0]], at[p[1]])} and len(used) > 1
