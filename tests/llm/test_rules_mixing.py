import random
from collections import Counter

import pytest
from helpers import awkward, documents, prose, words
from pyspark.sql import functions as F

from isochrone.llm import mixing, quality_rules


def brute_measures(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(inside), sum("A" <= c <= "Z" for c in text))


def test_measures_equal_brute_force(spark):
    rng = random.Random(1)
    rows = awkward() + [(20, "a b c d e " * 4), (21, "A# B* C|\nx\nx\n x\nA# B* C|"), (22, prose(rng, 30) + " " + prose(random.Random(2), 9) + " " + prose(random.Random(2), 9))]
    got = quality_rules.measure(documents(spark, rows)).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(brute_measures(r[1]) for r in rows)


def test_policies_and_ablation(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60)) for i in range(20)] + [(100, "few words"), (101, "a b c d e f " * 10), (102, " | ".join(prose(rng, 1) for _ in range(40))), (103, prose(rng, 40).upper())]
    recorded = quality_rules.ledger(quality_rules.measure(documents(spark, rows)))
    kept = {r["doc_id"] for r in recorded.where(quality_rules.kept()).collect()}
    assert kept == set(range(20))
    masks = [r["failed"] for r in recorded.collect()]
    for row in quality_rules.ablation(recorded, "prose-2").collect():
        bit, full = quality_rules.mask([row["rule"]]), quality_rules.mask(quality_rules.POLICIES["prose-2"])
        assert row["failing"] == sum(bool(m & bit) for m in masks)
        assert row["only_this"] == sum(m & full == bit for m in masks)
        assert row["kept_without"] == sum(not m & full & ~bit for m in masks)
    with pytest.raises(ValueError):
        quality_rules.mask(["no_such_rule"])


def test_filter_keeps_columns_and_empty_tables(spark):
    docs = documents(spark, awkward())
    out = quality_rules.filter_documents(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert {r["doc_id"] for r in out.collect()} == {None, 4, 5, 6, 8}
    assert out.where("doc_id = 4").count() == 2
    assert quality_rules.filter_documents(docs.limit(0)).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = budget * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= cap * sizes[s]}
        if not over:
            return share | {s: cap * sizes[s] for s in capped}
        capped |= over
        if len(capped) == len(names):
            return {s: cap * sizes[s] for s in names}


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 3, 50, 1000, 20_000]) for s in ["a", "B", "é", "zz", "\U0001f642", "￮", None][: 3 + seed]}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"))
    want = brute_targets(sizes)
    for r in got.collect():
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)


def test_mix_is_near_its_target_and_repeats(spark):
    rng = random.Random(5)
    docs = documents(spark, awkward() + [(100 + i, prose(rng, rng.randint(1, 40)), rng.choice(["a", "b", "c"])) for i in range(3000)])
    first = mixing.mix(docs)
    rows = first.select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert len(rows) == 3011 and Counter(rows) == Counter(mixing.mix(docs.repartition(5)).select(*rows[0].__fields__).collect())
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert all(0 <= r["copies"] <= 2 for r in own)
        if len(own) > 500:
            own = [r for r in own if r["size"] < 1000]
            rate = own[0]["target"] / own[0]["source_size"]
            assert sum(r["copies"] for r in own) / len(own) == pytest.approx(rate, abs=0.06)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("copies")).first()[0] == 0
