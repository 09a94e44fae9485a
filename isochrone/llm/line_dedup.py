"""Fuzzy line deduplication by MinHash; one line of each group of near-equal lines stays.

A line is compared in normal form: white space trimmed and collapsed. Lines are near-equal when the
Jaccard similarity of their sets of ``GRAM`` consecutive characters is at least ``SIMILARITY``.

1. Sketch. Each document is split in its task; every line that the batch has not seen yet is sketched over
   the runs of ``GRAM`` characters at every position: ``BANDS * ROWS`` minima of their hashes, each under a
   multiplication of its own, and the number of distinct runs. Its buckets: a line of fewer than ``SHORT`` runs has
   those of lines that agree on all rows of a band (a pair at the threshold shares none with a probability of
   (1 - 0.8 ** 4) ** 13 = 0.1 %); a longer one has its smallest window of 12 or 18 characters in each of ``BANDS``
   bins. Edits that leave 0.8 of the runs leave windows (figures in the README).
2. Pairs. A line travels with one number, its sign: the logarithm of its number of runs and one bit of each minimum.
   Members of a bucket of up to ``DIRECT`` rows are paired, those of a larger one are paired with its first line: linear in
   the bucket (``HEADS`` orders take turns, so a large group of near copies is not held to one of its lines). Only pairs whose signs allow a link become rows (a pair at the threshold is lost with a probability of
   0.012 %, ``LEAST_SIGNS``), however many lines have a passage in common. The buckets are dealt out in ``PASSES``
   passes, so that a part of their rows at a time is on disk.
3. Verification. Before any text is read, pairs go whose numbers of runs rule a link out (exact), or whose minima agree in so
   few places that a pair at the threshold would with a probability of 0.03 % (``LEAST_AGREEING``). The others are
   compared exactly, on the full sets of runs. Components follow from the links.
4. Rest. Only larger buckets whose members are still in different components can hide a link. Up to ``SMALL_BUCKET``
   members are compared across components, by sizes and minima as in 3; those of larger buckets are paired through their rarest runs
   (``rarest_runs``), chosen in the tasks under one rough order of frequency: it loses no pair, and other runs are not shuffled.
   Members of a bucket's largest component are not compared with each other.
5. Every line of a component but its first occurrence, by (doc_id, line number), is removed.

Sketch and verification run in NumPy and pandas inside Arrow batches: written with DataFrame functions the
sketch alone took 2.6 times the whole budget (figures in the README). All else are DataFrame operations.

Defined results: NULL text is empty; blank lines are never touched or counted; documents without
``doc_id`` come after all others and are told apart by their text; repeated rows are one document and
keep the same lines; an empty table gives an empty result; a line of any length is sketched and compared whole,
one line at a time where it exceeds ``BLOCK_RUNS``; columns beside ``text`` (and ``n_chars``, which is counted
anew) are carried as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, discard, require, split_words, stored, text_of
from .components import connected_components
from .set_links import SLACK, across_components, main_marked, open_members, pairs_sharing, sizes_allow

GRAM = 5
SIMILARITY = 0.8
BANDS, ROWS = 13, 4
#: Numbers of runs from which a line has buckets of windows of the first and of the second of ``WIDTHS``.
SHORT, LONG = 20, 90
WIDTHS = (12, 18)
#: Bits of a bucket's and of a node's number: shuffled rows stay small, and chance agreements are rare and harmless.
BUCKET_BITS, NODE_BITS = 44, 48
#: Minima (their lowest four bits are kept) in which a pair must agree to be compared at all.
LEAST_AGREEING = 32
#: Bits of the minima (one each) in which a pair must agree to become a row, and the most by which its logarithms may differ.
LEAST_SIGNS, SIZE_STEPS = 38, 64
#: Rows of a bucket that are paired at once; members that are compared across components by their minima.
DIRECT, SMALL_BUCKET = 32, 1 << 14
#: Orders in which the first line of a larger bucket is found, and what turns a node's bits for each.
HEADS, TURN = 4, 0x2B67A1C9D3E5
#: Parts of the buckets whose rows are on disk one after another, and pairs to a text that are compared at a time.
PASSES, PAIRS_A_TEXT = 2, 4
SEED = 42
#: Runs that are sketched at once (a longer line is a block of its own), and lines one output batch holds.
BLOCK_RUNS = 1 << 17
BATCH_LINES = 20_000
#: Counters of runs (and how many travel in one row), and lines whose rarest runs one output batch holds.
RUN_SLOTS, SLOT_BLOCK = 1 << 18, 1 << 12
PICKED_LINES = 2_000
#: Bits of the bitmap of lines whose texts are asked for: 4 MB.
FILTER_BITS = 1 << 25

_rng = np.random.default_rng(SEED)
_CHARACTERS = _rng.integers(0, 2**63, GRAM, dtype="uint64") * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = _rng.integers(2**29, 2**31, BANDS * ROWS, dtype="uint32") * np.uint32(2) + np.uint32(1)
_STEPS = np.random.default_rng(SEED + 1).integers(0, 2**63, 8, dtype="uint64") * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(0, 2**63, (BANDS, ROWS), dtype="uint64") * np.uint64(2) + np.uint64(1)


def _run_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of some lines, one line after another, and where each line's begin."""
    padded = [x if len(x) >= GRAM else x.ljust(GRAM, "\0") for x in lines]
    lengths = np.fromiter(map(len, padded), "int64", len(padded))
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    h = points[: len(points) - GRAM + 1] * _CHARACTERS[0]
    for i in range(1, GRAM):
        h += points[i : len(points) - GRAM + 1 + i] * _CHARACTERS[i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    # runs that start in the last characters of a line would reach into the next one
    ends = np.cumsum(lengths)
    inside = np.ones(len(points), bool)
    for i in range(1, GRAM):
        inside[ends - i] = False
    return h[inside[: len(h)]], np.cumsum(lengths - GRAM + 1) - (lengths - GRAM + 1)


def _least_windows(h: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """The smallest hash of the windows of ``width`` characters in each of ``BANDS`` bins, lines by bins; what falls into a
    bin depends on the window only. An empty bin has the smallest of the whole line. ``h``, ``counts``: the runs of the
    lines and their numbers."""
    reach = width - GRAM
    w = h[: len(h) - reach] * _STEPS[0]
    for i, at in enumerate([*range(GRAM, reach, GRAM), reach], 1):
        w += h[at : at + len(w)] * _STEPS[i]
    # windows that start in the last runs of a line would reach into the next one
    ends, inside = np.cumsum(counts), np.ones(len(h), bool)
    for i in range(1, reach + 1):
        inside[ends - i] = False
    w = w[inside[: len(w)]]
    w ^= w >> np.uint64(32)
    w *= np.uint64(0x9E3779B97F4A7C15)
    w ^= w >> np.uint64(29)
    bins = (((w & np.uint64(0xFFFFFFFF)) * np.uint64(BANDS)) >> np.uint64(32)).view("int64")
    bins += np.repeat(np.arange(0, len(counts) * BANDS, BANDS), counts - reach)
    least = np.full(len(counts) * BANDS, np.iinfo("uint64").max, "uint64")
    np.minimum.at(least, bins, w)
    least = least.reshape(-1, BANDS)
    return np.where(least == np.iinfo("uint64").max, least.min(axis=1, keepdims=True), least)


def sketch(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of distinct runs of each line, its buckets (lines by twice ``BANDS``, some of them repeated), and four bits
    of each of its minima, sixteen to a number."""
    h, starts = _run_hashes(lines)
    counts = np.diff(starts, append=len(h))
    small = (h >> np.uint64(32)).astype("uint32")
    minima = np.empty((len(lines), BANDS * ROWS), "uint64")
    for i, m in enumerate(_MULTIPLIERS):
        minima[:, i] = np.minimum.reduceat(small * m, starts)
    owner = np.repeat(np.arange(len(lines), dtype="uint64"), counts)
    keys = np.sort(owner << np.uint64(44) | h >> np.uint64(20))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    sizes = np.add.reduceat(first, starts, dtype="int64")
    # bands of minima, or windows of two widths: what a line has follows from its size, and near-equal lines have one in common
    buckets = np.zeros((len(lines), 2, BANDS), "uint64")
    mixed = minima.reshape(-1, BANDS, ROWS) * _MIX
    mixed ^= mixed >> np.uint64(32)
    # a band is part of its bucket's name
    bands = np.bitwise_xor.reduce(mixed * _MIX[:, ::-1], axis=2) ^ (np.arange(BANDS, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15))
    short = sizes * SIMILARITY < SHORT
    buckets[short, 0] = bands[short]
    for place, width, own in ((1, WIDTHS[0], (sizes >= SHORT) & (sizes * SIMILARITY < LONG)), (0, WIDTHS[1], sizes >= LONG)):
        if own.any():
            kept = _least_windows(h[np.repeat(own, counts)], counts[own], width)
            buckets[own, place] = (kept ^ np.uint64(width)) * np.uint64(0xD6E8FEB86659FD93)
    for place, lacks in ((0, ~short & (sizes < LONG)), (1, (sizes < SHORT) | (sizes * SIMILARITY >= LONG))):
        buckets[lacks, place] = buckets[lacks, 1 - place]
    few = np.zeros((len(lines), -(-BANDS * ROWS // 16) * 16), "uint64")
    # the minima are small numbers by nature; mixed, any four bits tell them apart
    few[:, : BANDS * ROWS] = (minima * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60))
    marks = np.bitwise_or.reduce(few.reshape(len(lines), -1, 16) << (np.arange(16, dtype="uint64") * np.uint64(4)), axis=2)
    return sizes, (buckets.reshape(len(lines), -1) >> np.uint64(64 - BUCKET_BITS)).view("int64"), marks.view("int64")


def signs(sizes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """One number a line: the lowest bit of each of its ``BANDS * ROWS`` minima, and above them the logarithm of its size."""
    out = np.round(np.log2(sizes) * SIZE_STEPS).astype("uint64") << np.uint64(BANDS * ROWS)
    for i in range(BANDS * ROWS):
        out |= (marks[:, i // 16].view("uint64") >> np.uint64(4 * (i % 16)) & np.uint64(1)) << np.uint64(i)
    return out.view("int64")


def signs_allow(a: str, b: str) -> Column:
    """Whether lines of these signs can be near-equal."""
    bits = BANDS * ROWS
    agree = bits - F.bit_count(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.lit((1 << bits) - 1)))
    apart = F.abs(F.shiftrightunsigned(a, bits) - F.shiftrightunsigned(b, bits))
    return (agree >= LEAST_SIGNS) & (apart <= math.ceil(-SIZE_STEPS * math.log2(SIMILARITY)) + 1)


def _blocks(lines: list[str]) -> Iterator[list[str]]:
    """The lines in blocks of up to ``BLOCK_RUNS`` characters, a longer line alone."""
    at = 0
    while at < len(lines):
        end, runs = at, 0
        while end < len(lines) and (end == at or runs + len(lines[end]) <= BLOCK_RUNS):
            runs += len(lines[end])
            end += 1
        yield lines[at:end]
        at = end


def _sketches(lines: list[str]) -> list[np.ndarray]:
    """``sketch`` of any number of lines, block by block."""
    parts = [sketch(block) for block in ([["-"], *_blocks(lines)])]
    return [np.concatenate(x)[1:] for x in zip(*parts, strict=True)]


def normal_lines(data: bytes) -> list[tuple[int, bytes]]:
    """(number, normal form) of the lines of a UTF-8 text that are not blank."""
    out = []
    for i, line in enumerate(data.split(b"\n")):
        norm = b" ".join(line.split())
        if norm:
            out.append((i, norm))
    return out


def sketched_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_lines, line_no, key (16 bytes), runs, buckets, marks, sign of every line that is not blank.

    The last four are NULL where the same batch has the line before. A task keeps nothing between batches.
    """
    require(docs, "doc_id", "text")
    rows = docs.select("doc_id", text_of().alias("text"))
    names = ["doc_id", "text_hash", "n_lines", "line_no", "key", "runs", "buckets", "marks", "sign"]
    kinds = [T.LongType(), T.IntegerType(), T.IntegerType(), T.BinaryType(), T.IntegerType(), *[T.ArrayType(T.LongType())] * 2, T.LongType()]
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=True)]])

    def emit(batch, spots, news):
        sketches = _sketches([n.decode("utf-8", "surrogatepass") for n in news.values()])
        sketches.append(signs(sketches[0], sketches[2]))
        place = {k: i for i, k in enumerate(news)}
        at = pa.array([s[0] for s in spots], pa.int64())
        fresh = [place.pop(s[3], None) for s in spots]
        sketches[1] = [np.unique(x) for x in sketches[1]]
        columns = [batch.column(0).take(at), batch.column(1).take(at), *[pa.array([s[j] for s in spots], t) for j, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.binary()))]]
        columns += [pa.array([None if i is None else x[i] for i in fresh], t) for x, t in zip(sketches, (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spots, news, known = batch.column(2).cast(pa.large_binary()), [], {}, set()
            for i in range(batch.num_rows):
                lines = normal_lines(texts[i].as_py())
                for number, norm in lines:
                    key = hashlib.md5(norm, usedforsecurity=False).digest()
                    spots.append((i, len(lines), number, key))
                    if key not in known:
                        known.add(key)
                        news[key] = norm
                if len(spots) >= BATCH_LINES:
                    yield emit(batch, spots, news)
                    spots, news = [], {}
            if spots:
                yield emit(batch, spots, news)

    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def placed_lines(sketched: DataFrame, part: int) -> DataFrame:
    """bucket, node, a, b over one of the ``PASSES`` parts of the buckets: pairs (a, b) of nodes that their signs allow, ``bucket`` and
    ``node`` NULL, in buckets of up to ``DIRECT`` rows; and each row of a larger one, a pair with its first line if their signs allow
    it, else ``b`` is NULL.

    A node is the first bits of a line's key; links name the whole keys, so two lines that agree in these
    bits are still told apart. The bucket rows travel once; a window reads them in order, however many one bucket has.
    """
    # nodes in a bucket's own order; all three branches read one shuffle, so they ask for the same plain columns, none NULL
    turn = F.pmod(F.shiftright("bucket", 8), F.lit(HEADS)) * TURN
    lines = sketched.where("buckets IS NOT NULL").select(node_of().alias("node"), "sign", "buckets").select(F.explode("buckets").alias("bucket"), "node", "sign")
    lines = lines.where(F.pmod("bucket", F.lit(PASSES)) == part).select("bucket", F.col("node").bitwiseXOR(turn).alias("x"), "sign").where("x IS NOT NULL AND sign IS NOT NULL")
    own = Window.partitionBy("bucket")
    ends = lines.select("*", F.min("x").over(own).alias("y"), F.min_by("sign", "x").over(own).alias("sign_y"), F.max("x").over(own).alias("last"), F.count("*").over(own).alias("n")).where("y < last")
    near = (F.col("x") > F.col("y")) & signs_allow("sign", "sign_y")
    few = ends.where(F.col("n") <= DIRECT).select("bucket", "x", "sign")
    pairs = few.join(few.select("bucket", F.col("x").alias("y"), F.col("sign").alias("sign_y")), "bucket").where(near)
    large = ends.where(F.col("n") > DIRECT)
    x, y = (F.col(c).bitwiseXOR(turn) for c in "xy")
    large = large.select("bucket", x.alias("node"), F.when(near, F.greatest(x, y)).alias("a"), F.when(near, F.least(x, y)).alias("b"))
    pairs = pairs.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    none = F.lit(None).cast("long")
    return large.union(pairs.select(none, none, "a", "b"))


def node_of() -> Column:
    return F.conv(F.substring(F.hex("key"), 1, NODE_BITS // 4), 16, 10).cast("long")


def node_bits(nodes: DataFrame) -> bytes:
    """A bitmap of ``FILTER_BITS`` bits with those of the nodes set: ``FILTER_BITS / 8`` bytes, whatever their number."""
    at = F.pmod("node", F.lit(FILTER_BITS))
    words = nodes.groupBy(F.floor(at / 32).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(32)).cast("int"))).alias("bits"))
    out = np.zeros(FILTER_BITS // 32, "<u4")
    for part in words.toLocalIterator():
        out[part["word"]] = part["bits"]
    return out.tobytes()


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, key, norm of the lines asked for.

    The tasks read all texts and let through what hits the bitmap of the nodes; the join settles the rest.
    With so many nodes that the bitmap fills up, more texts are shuffled and none is lost.
    """
    bits = docs.sparkSession.sparkContext.broadcast(node_bits(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            own = {}
            for text in batch.column(0).cast(pa.large_binary()):
                for _, norm in normal_lines(text.as_py()):
                    key = hashlib.md5(norm, usedforsecurity=False).digest()
                    at = int.from_bytes(key[: NODE_BITS // 8], "big") % FILTER_BITS
                    if known[at >> 3] >> (at & 7) & 1:
                        own[key] = norm
                if len(own) >= BATCH_LINES:
                    yield made(own)
                    own = {}
            yield made(own)

    def made(own):
        return pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([x.decode("utf-8", "replace") for x in own.values()], pa.string())], ["key", "norm"])

    rows = docs.select(text_of().alias("text")).mapInArrow(run, "key binary, norm string").withColumn("node", node_of())
    # a stored table of nodes: Spark knows its size, and sends it to the texts only if it is small
    return rows.join(nodes, "node", "left_semi").dropDuplicates(["key"])


def runs_of(text: str) -> set[str]:
    """The runs of a line; a shorter one is a run itself."""
    return {text[i : i + GRAM] for i in range(max(1, len(text) - GRAM + 1))}


@F.pandas_udf(T.BooleanType())
def near_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the Jaccard similarity of the runs of two lines reaches ``SIMILARITY``."""
    out, last, x = [], None, set()
    for left, right in zip(a, b, strict=True):
        if right != last:
            last, x = right, runs_of(right)
        y = runs_of(left)
        common = len(x & y)
        out.append(common >= SIMILARITY * (len(x) + len(y) - common) - 1e-9)
    return pd.Series(out, dtype="bool")


def run_counts(texts: DataFrame) -> np.ndarray:
    """How often the runs of the texts occur, added up over ``RUN_SLOTS`` slots of their hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(RUN_SLOTS, "int64")
        for batch in batches:
            for block in _blocks(batch.column(0).to_pylist()):
                own += np.bincount(_slots(_run_hashes(block)[0]), minlength=RUN_SLOTS)
        blocks = own.reshape(-1, SLOT_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], ["block", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLOT_BLOCK, "int64")
        for x in rows["counts"]:
            total += np.frombuffer(x, "int64")
        return pd.DataFrame({"block": rows["block"].iloc[:1], "counts": [total.tobytes()]})

    kind = "block int, counts binary"
    out = np.zeros((RUN_SLOTS // SLOT_BLOCK, SLOT_BLOCK), "int64")
    for part in texts.select("norm").mapInArrow(count, kind).groupBy("block").applyInPandas(add, kind).toLocalIterator():
        out[part["block"]] = np.frombuffer(part["counts"], "int64")
    return out.reshape(-1)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(RUN_SLOTS)).astype("int64")


def rarest_runs(texts: DataFrame) -> DataFrame:
    """node, n, element: of each text the runs of which near-equal texts share one at least (see ``set_links``), in the order
    of ``run_counts``. Any order that all texts have in common loses no pair; a rough one costs some pairs more. Runs that
    occur once are left out. No other run leaves its task."""
    counts = texts.sparkSession.sparkContext.broadcast(run_counts(texts))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, PICKED_LINES):
                sizes, parts = [], []
                for text in batch.column(1).slice(at, PICKED_LINES):
                    h = np.unique(_run_hashes([text.as_py()])[0])
                    n = often[_slots(h)]
                    first = np.argsort(n, kind="stable")[: len(h) - math.ceil(SIMILARITY * len(h) - SLACK) + 1]
                    parts.append(h[first[n[first] > 1]].view("int64"))
                    sizes.append(len(h))
                where = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
                node = batch.column(0).slice(at, PICKED_LINES).take(pa.array(where, pa.int64()))
                yield pa.RecordBatch.from_arrays([node, pa.array(np.array(sizes, "int32")[where]), pa.array(np.concatenate(parts))], ["node", "n", "element"])

    return texts.select("node", "norm").mapInArrow(pick, "node long, n int, element long")


def agreeing(a: str, b: str) -> Column:
    """In how many minima two lines agree, by the four bits kept of each."""
    mask = 0x1111111111111111

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for step in (2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        return F.bit_count(d.bitwiseAND(F.lit(mask)))

    numbers = -(-BANDS * ROWS // 16)
    return F.lit(BANDS * ROWS) - sum((differing(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(numbers)), F.lit(0))


def facts_of(sketched: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, runs, marks of the nodes asked for."""
    facts = sketched.where("buckets IS NOT NULL").select(node_of().alias("node"), "runs", "marks")
    return facts.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def minima_allow(a: str, b: str) -> Column:
    """Whether the numbers of runs and the minima of two lines, in columns that end in ``a`` and ``b``, allow a link."""
    return sizes_allow(F.col(f"runs_{a}"), F.col(f"runs_{b}"), SIMILARITY) & (agreeing(f"marks_{a}", f"marks_{b}") >= LEAST_AGREEING)


def worth_reading(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and minima allow a link; ``facts`` is node, runs, marks."""
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(side), F.col("runs").alias(f"runs_{side}"), F.col("marks").alias(f"marks_{side}")), side)
    return pairs.where(minima_allow("a", "b")).select("a", "b")


def verified(docs: DataFrame, pairs: DataFrame, name: str, used: list[str]) -> DataFrame:
    """Those of the distinct pairs (a, b) of nodes that are near-equal, with their keys. Both texts travel with a pair: of
    a large group of lines that are nearly near-equal, up to ``PAIRS_A_TEXT`` pairs a text at a time."""
    own: list[str] = []
    pairs = stored(pairs, f"{name}-pairs", own)
    asked = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), f"{name}-asked", own)
    texts = stored(texts_of(docs, asked), f"{name}-texts", own)
    left = texts.select(F.col("node").alias("a"), F.col("key").alias("key_a"), F.col("norm").alias("norm_a"))
    right = texts.select(F.col("node").alias("b"), F.col("key").alias("key_b"), F.col("norm").alias("norm_b"))
    turns, links = max(1, math.ceil(pairs.count() / (PAIRS_A_TEXT * max(1, asked.count())))), []
    for turn in range(turns):
        both = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == turn).join(left, "a").join(right, "b")
        links.append(stored(both.where(near_equal(F.col("norm_a"), F.col("norm_b"))).select("a", "b", "key_a", "key_b"), f"{name}-links", used))
    discard(docs.sparkSession, own)
    return reduce(DataFrame.union, links)


def line_components(docs: DataFrame, sketched: DataFrame, used: list[str]) -> DataFrame:
    """(key, component) of the lines that have near-equal ones. ``used`` notes the folders it is read from."""
    parts = [stored(placed_lines(sketched, part), "line-places", used) for part in range(PASSES)]
    places = reduce(DataFrame.union, parts)
    first = stored(places.where("b IS NOT NULL").select("a", "b").distinct(), "line-first", used)
    members = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    facts = stored(facts_of(sketched, members), "line-facts", used)
    linked = verified(docs, worth_reading(first, facts), "line-star", used)
    groups = connected_components(linked, into=used)
    rest = stored(open_members(places.where("bucket IS NOT NULL").select("bucket", "node").distinct(), groups, ["bucket"]), "line-open", used)
    sizes = rest.groupBy("bucket").agg((F.count("*") > SMALL_BUCKET).alias("large"))
    facts = stored(facts_of(sketched, rest.select("node").distinct()), "line-facts", used)
    rest = stored(main_marked(rest.join(sizes, "bucket"), ["bucket"]).join(facts, "node"), "line-rest", used)
    one, two = (rest.where("NOT large").select("bucket", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "component", "main", "runs", "marks")]) for side in "xy")
    both = one.where("NOT main_x").join(two, "bucket").where(across_components() & minima_allow("x", "y"))
    across = both.select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")).distinct()
    large = rest.where("large").select("bucket", "node", "component", "runs", "marks")
    asked = stored(large.select("node").distinct(), "line-large", used)
    if not asked.isEmpty():
        texts = stored(texts_of(docs, asked).select("node", "norm"), "line-large-texts", used)
        rarest = stored(rarest_runs(texts), "line-rarest", used)
        across = across.union(pairs_sharing(large, rarest, ["bucket"], SIMILARITY, minima_allow("x", "y"))).distinct()
    across = across.join(first, ["a", "b"], "left_anti")
    more = verified(docs, across, "line-more", used)
    links = linked.select("key_a", "key_b").union(more.select("key_a", "key_b"))
    return connected_components(links, "key_a", "key_b", used).select(F.col("node").alias("key"), "component")


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_lines, removed: per document with lines that are not blank, the numbers
    (from 0) of those to go, in order. What lies between the texts and this table is deleted."""
    spark, used, sketches = docs.sparkSession, [], []
    sketched = stored(sketched_lines(docs), "line-sketches", sketches)
    spots = sketched.select("doc_id", "text_hash", "line_no", "key")
    groups = line_components(docs, sketched, used)
    no_id, id_of = F.col("doc_id").isNull().alias("no_id"), F.col("doc_id")
    spot = F.struct(no_id, id_of, "text_hash", "line_no")
    # only lines that occur again, or resemble another, can go
    again = spots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(None).cast("binary").alias("component"))
    marks = stored(again.union(groups), "line-marked", sketches)
    discard(spark, used)
    marked = marks.groupBy("key").agg(F.max("component").alias("component")).select("key", F.coalesce("component", "key").alias("component"))
    own = stored(spots.join(marked, "key").select("component", spot.alias("spot")), "line-spots", sketches)
    heads = own.groupBy("component").agg(F.min("spot").alias("head"))
    gone = own.join(heads, "component").where("spot <> head").select("spot.*").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    per = sketched.select("doc_id", "text_hash", "n_lines").distinct()
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "removed")
    joined = per.join(gone, per["doc_id"].eqNullSafe(gone["gone_id"]) & (per["text_hash"] == gone["gone_hash"]), "left")
    out = stored(joined.select("doc_id", "text_hash", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed")), "line-removed")
    discard(spark, sketches)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines; documents that had words and lose them all go."""
    per = removed_lines(docs).where(F.size("removed") > 0).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "removed")
    # the text travels once, inside the row
    own = docs.select(carried(docs), "doc_id", F.xxhash64(text_of()).alias("own_hash"))
    joined = own.join(per, own["doc_id"].eqNullSafe(per["gone_id"]) & (own["own_hash"] == per["gone_hash"]), "left")
    text = F.col("row").getField("text")
    parts = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "removed")
    same = F.col("removed").isNull()
    joined = joined.withColumn("new_text", F.when(same, text).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")))
    joined = joined.where(same | (F.size(split_words(F.col("new_text"))) > 0))
    out = {c: F.col("row").getField(c) for c in docs.columns}
    out["text"] = F.col("new_text")
    if "n_chars" in out:
        out["n_chars"] = F.when(same, out["n_chars"]).otherwise(F.length("new_text")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[out[c].alias(c) for c in docs.columns])
