import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from isochrone.llm import centroid_clusters, fill_in_middle, packing, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


# centroid clusters


def brute_clusters(rows, clusters, rounds):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    points = [(i, [math.floor(256 * x) for x in v]) for i, v in kept]
    order = sorted(points, key=lambda p: (hashlib.sha256(f"2:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in points:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centroids)]
    out = [(i, *nearest(v)) for i, v in points]
    total, per = sum(d for _, d, _ in out), {}
    for _, d, k in out:
        per[k] = per.get(k, 0) + d
    fits = lambda x: x if x < 2**63 else None
    big = any(d >= 2**63 for _, d, _ in out)
    lost = {k for _, d, k in out if d >= 2**63}
    return sorted(((i, k, fits(d), None if k in lost else fits(per[k]), None if big else fits(total), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in out), key=str)


def vectors(seed, n):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [float(np.float32(m + rng.gauss(0, 0.3))) for m in rng.choice(middles)]) for i in range(n)]
    same = [0.25] * 64
    rows += [(1000 + i % 7, same) for i in range(40)] + [(None, same), (None, [0.5] * 64)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [1.0] * 63 + [float("nan")]), (2005, [float("inf")] * 64), (2006, [1.0] * 65)]
    return rows


@pytest.mark.parametrize("extra", [[], [(3000, [1e38] * 64), (3001, [-3e38] + [0.0] * 63)]])
def test_clusters_equal_brute_force(spark, extra, monkeypatch):
    monkeypatch.setattr(centroid_clusters, "BLOCK", 50)
    rows = vectors(1, 150) + extra
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, cluster string").repartition(5)
    got = sorted((tuple(r) for r in centroid_clusters.cluster(table, clusters=9, rounds=4).collect()), key=str)
    assert got == brute_clusters(rows, 9, 4)


def test_few_or_no_vectors(spark):
    rows = [(1, [0.0] * 64), (2, [1.0] * 64), (2, [1.0] * 64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = centroid_clusters.cluster(table)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_clusters(rows, 40, 5)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    none = centroid_clusters.cluster(table.limit(0))
    assert none.count() == 0 and none.columns == out.columns


def test_distances_are_table_sums():
    rng = np.random.default_rng(0)
    v, c = rng.integers(-300, 300, (500, 64)), rng.integers(-300, 300, (7, 64))
    assert (centroid_clusters.distances(v, c) == ((v[:, None] - c) ** 2).sum(axis=2)).all()


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 20), st.integers(0, 2**16), st.integers(0, 2**32 - 1)), min_size=1, max_size=700))
def test_blocks_round_trip(ids):
    ids = np.array(ids, "uint32")
    body, size, low, width, exceptions = token_files.encode_blocks(ids)
    assert len(body) == size.sum() and len(size) == -(-len(ids) // 128)
    out = token_files.decode_blocks(np.frombuffer(body, "uint8"), np.cumsum(size) - size, low, width, exceptions)
    assert out[: len(ids)].tolist() == ids.tolist()


def test_outliers_are_exceptions():
    ids = np.full(128, 1000, "uint32")
    ids[5:15] = 2**31
    body, size, low, width, exceptions = token_files.encode_blocks(ids)
    # 90 % of the block needs no bit: ten exceptions of five bytes are the whole block
    assert (size.tolist(), low.tolist(), width.tolist(), exceptions.tolist()) == ([50], [1000], [0], [10])
    wide = np.arange(128, dtype="uint32")
    assert token_files.encode_blocks(wide)[1].tolist() == [16 * 7]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("file_bytes", [2000, 1 << 20])
def test_files_equal_the_tokenizer(spark, file_bytes, monkeypatch):
    monkeypatch.setattr(token_files, "STEP", 4)
    monkeypatch.setattr(token_files, "FILE_GROUP", 3)
    rng = random.Random(5)
    rows = awkward() + [(100 + rng.randrange(50), prose(rng, rng.choice([1, 20, 300]))) for _ in range(80)] + [(None, prose(rng, 10)) for _ in range(5)]
    docs = documents(spark, rows).repartition(3)
    manifest = token_files.write_files(docs, PATH, file_bytes=file_bytes)
    files = manifest.orderBy("part").collect()
    assert (len(files) > 3) == (file_bytes == 2000)
    got = sorted(token_files.read_files(spark, manifest, with_ids=True).collect(), key=lambda r: r["start"])
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(r[0]), ids_of(r[1])) for r in rows)
    assert [(r["doc_id"] is None, r["doc_id"] or 0) for r in got] == sorted((r[0] is None, r[0] or 0) for r in rows)
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        at += r["n_tokens"]
    # any document, without the others
    system, path = token_files._files(files[0]["file"])
    with system.open_input_file(path) as source:
        reader = token_files.Reader(source)
        for i in reversed(range(len(reader.names))):
            assert reader.document(i).tolist() == got[i]["ids"]
        assert (len(reader.names), len(reader.start), reader.tokens, reader.bytes) == tuple(files[0][c] for c in ("documents", "blocks", "tokens", "bytes"))


def test_hot_id_fills_several_files_and_empty_table(spark):
    rng = random.Random(6)
    rows = [(7, prose(rng, 30)) for _ in range(300)]
    manifest = token_files.write_files(documents(spark, rows), PATH, file_bytes=8000)
    assert manifest.count() > 4
    assert token_files.read_files(spark, manifest).agg(F.sum("n_tokens")).first()[0] == sum(len(ids_of(t)) for _, t in rows)
    none = token_files.write_files(documents(spark, rows).limit(0), PATH)
    assert none.count() == 0 and token_files.read_files(spark, none).count() == 0


def test_cut_file_is_refused(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "x.pfor")
    w = token_files.Writer(fs.LocalFileSystem().open_output_stream(path))
    w.add("1", np.arange(500, dtype="<u4").tobytes())
    w.close()
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-3])
    with fs.LocalFileSystem().open_input_file(path) as f, pytest.raises(ValueError, match="cut short"):
        token_files.Reader(f)


# fill in the middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def brute_middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_middle_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [r[:2] for r in awkward()] + [(20, "abc" * 9000), (21, "é" * 7000), (22, "🙂a" * 3000), (23, "x<P>y"), (24, "<M>"), (25, "<<S<"), (26, "\x00\n \t")]
    passages = [prose(rng, 200) for _ in range(5)]
    rows += [(100 + i, rng.choice(["", "ü", "\n"]).join(rng.choice(passages) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    rows += [(300 + i, "".join(rng.choice("aZ <>PSM1é🙂") for _ in range(rng.randint(0, 12)))) for i in range(200)]
    out = fill_in_middle.transform(documents(spark, rows).repartition(3))
    got = out.withColumn("text", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    want = [(r[0], *brute_middle(*r), r[1] or "") for r in rows]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fill_in_middle.transform(documents(spark, rows).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["word " * 150, "Z" * 5000, "日本" * 900, "mixed éa, "])), max_size=8))
def test_every_cut_of_a_text(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    data, memo = text.encode(), fill_in_middle.Memo(3)
    units = UNIT.findall(text)
    for _ in range(2):
        cuts = fill_in_middle.Cuts(data, memo)
        assert cuts.n == len(units) and (cuts.ends[-1] if data else 0) == len(data)
        for k in {0, 1, len(units) // 3, len(units) // 2, max(len(units) - 1, 0), len(units)}:
            before = "".join(units[:k])
            assert cuts.start(k) == (len(before.encode()), len(before))
    assert len(memo.new) <= 3 and len(memo.old) <= 3


def test_equal_passages_give_equal_chunks():
    rng = random.Random(8)
    passage, chunks = prose(rng, 3000).encode(), []
    for lead in (b"", b"x", prose(rng, 70).encode()):
        data = lead + passage
        ends = fill_in_middle.borders(data)
        assert all(0 < b - a <= fill_in_middle.LONGEST for a, b in zip([0, *ends], ends, strict=False))
        chunks.append({data[a:b] for a, b in zip([0, *ends], ends, strict=False)})
    shared = chunks[0] & chunks[1] & chunks[2]
    assert sum(map(len, shared)) >= 0.8 * len(passage)


def test_hash_is_the_same_across_steps(monkeypatch):
    rng = random.Random(9)
    data = prose(rng, 4000).encode()
    whole = fill_in_middle.borders(data)
    monkeypatch.setattr(fill_in_middle, "STEP", 1000)
    assert fill_in_middle.borders(data) == whole


def test_general_helpers_are_the_tokenizer():
    assert np.frombuffer(next(packing.encode_texts(["Some words, here."], PATH)), "<u4").tolist() == ids_of("Some words, here.")[:-1]
