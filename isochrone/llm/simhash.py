"""SimHash near-duplicates: vantage-point trees over fingerprints in Hamming space.

1. ``fingerprints`` hashes the word shingles of each text in its task. Equal fingerprints are one point.
2. The top of the tree is built from a bounded sample of points (``ROUTING_SAMPLE``) and splits at a
   distance to a vantage point: near points go inside, far ones outside. The sample decides where the
   borders lie, never which pairs are found.
3. Every point is sent to its shard, and those close to a border to both sides. For a border between the
   distances m and m + 1 the triangle bound says that two points at most ``radius`` apart meet on one
   side if all points whose distance is within ``ceil(radius / 2)`` of the border are on both sides.
4. Inside a shard the tree goes on until leaves are small, then all pairs of a leaf are compared with
   exact distances. Only the links of a spanning forest leave the task: enough for the components, and
   linear in the points however large a group of near copies is.
5. Links of all shards are joined by the distributed union-find in ``components``.

Defined results: a NULL text counts as empty; texts without words have fingerprint zero and are linked to
each other like any other; a NULL ``doc_id`` takes part, but a component is named by its smallest
non-NULL id (NULL if it has none); repeated rows get the same answer; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, require, stored, text_of
from .components import connected_components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Points from which the routing tree is built, and the fewest of them in one of its shards.
ROUTING_SAMPLE = 32_768
SHARD_SAMPLE = 64
#: Points in one shard that the routing aims at, and points of a leaf compared pair by pair.
SHARD_POINTS = 8_192
LEAF = 1_024

_BITS = np.unpackbits(np.arange(256, dtype="uint8")[:, None], axis=1).sum(axis=1).astype("uint8")


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    """Differing bits of 64-bit numbers."""
    return np.bitwise_count(points ^ np.uint64(vantage))


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all shingles of a UTF-8 text, upper case A-Z lowered."""
    import xxhash

    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), "int64", n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), "uint64", n - width + 1)
    ones = np.zeros(64, "int64")
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536].astype(">u8").view("uint8").reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    values = np.fromiter((fingerprint(t.encode("utf-8", "surrogatepass")) for t in texts), "uint64", len(texts))
    return pd.Series(values.view("int64"))


def fingerprint_of(text: Column) -> Column:
    """The 64 bits of a text as a signed number."""
    return _fingerprint(text)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the 64 bits as a signed number."""
    require(docs, "doc_id", "text")
    return docs.select("doc_id", _fingerprint(text_of()).alias("fp"))


def _reach(radius: int) -> int:
    """How far from a border a point must be sent to both sides."""
    return (radius + 1) // 2


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and a border whose sides hold about half of the points each; NULL if there is none."""
    best = None
    for vantage in rng.choice(points, min(4, len(points)), replace=False):
        d = distance(points, vantage)
        border = int(np.median(d))
        for m in (border - 1, border):
            inside = int((d <= m).sum())
            # points near the border count for both sides: prefer the split with the smaller larger side
            close = int(((d >= m - 0) & (d <= m + 1)).sum())
            larger = max(inside, len(points) - inside) + close
            if 0 < inside < len(points) and (best is None or larger < best[0]):
                best = (larger, vantage, m)
    return best and best[1:]


def routing_tree(sample: np.ndarray, shards: int, seed: int = 7):
    """Nested (vantage, border, inside, outside), a shard number at the ends."""
    rng, count = np.random.default_rng(seed), [0]

    def build(points: np.ndarray, wanted: int):
        cut = _split(points, rng) if wanted > 1 and len(points) >= 2 * SHARD_SAMPLE else None
        if cut is None:
            count[0] += 1
            return count[0] - 1
        inside = distance(points, cut[0]) <= cut[1]
        return (cut[0], cut[1], build(points[inside], wanted // 2), build(points[~inside], wanted - wanted // 2))

    return build(np.sort(sample), shards)


def route(tree, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the points and the shards they are sent to, one pair per copy."""
    where, shard = [], []

    def go(node, index: np.ndarray) -> None:
        if not len(index):
            return
        if not isinstance(node, tuple):
            where.append(index)
            shard.append(np.full(len(index), node))
            return
        d = distance(points[index], node[0]).astype("int64")
        go(node[2], index[d <= node[1] + _reach(radius)])
        go(node[3], index[d > node[1] - _reach(radius)])

    go(tree, np.arange(len(points)))
    return (np.concatenate(where), np.concatenate(shard)) if where else (np.zeros(0, "int64"), np.zeros(0, "int64"))


class _Union:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def shard_links(points: np.ndarray, radius: int, seed: int = 11) -> list[tuple[int, int]]:
    """Links of a spanning forest of the points at most ``radius`` apart, as positions."""
    points = np.asarray(points, "uint64")
    union, links, rng = _Union(len(points)), [], np.random.default_rng(seed)

    def compare(index: np.ndarray) -> None:
        own = points[index]
        for i in range(len(index) - 1):
            for j in np.flatnonzero(distance(own[i + 1 :], own[i]) <= radius):
                if union.join(int(index[i]), int(index[i + 1 + j])):
                    links.append((int(index[i]), int(index[i + 1 + j])))

    todo = [np.arange(len(points))]
    while todo:
        index = todo.pop()
        cut = _split(points[index], rng) if len(index) > LEAF else None
        if cut is None:
            compare(index)
            continue
        d = distance(points[index], cut[0]).astype("int64")
        sides = [index[d <= cut[1] + _reach(radius)], index[d > cut[1] - _reach(radius)]]
        if max(map(len, sides)) > 0.9 * len(index):  # a ball too dense to be divided
            compare(index)
        else:
            todo += sides
    return links


def fingerprint_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) fingerprints at most ``radius`` apart, enough of them to connect what is connected.

    ``points`` is a stored table of distinct ``fp``.
    """
    total = points.count()
    share = min(1.0, ROUTING_SAMPLE / max(total, 1))
    # fingerprints are hashes already; the sample is those whose hash is smallest in about this share
    limit = int(share * 2**31)
    picked = points.where(F.pmod(F.xxhash64("fp"), F.lit(2**31)) < limit).limit(2 * ROUTING_SAMPLE)
    sample = np.array([r[0] for r in picked.collect()], "int64").view("uint64")
    tree = points.sparkSession.sparkContext.broadcast(routing_tree(sample, max(1, -(-total // SHARD_POINTS))) if len(sample) else 0)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame["fp"].to_numpy("int64")
            where, shard = route(tree.value, own.view("uint64"), radius)
            yield pd.DataFrame({"shard": shard, "fp": own[where]})

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(frame["fp"].to_numpy("int64").view("uint64"))
        links = np.array(shard_links(own, radius), "int64").reshape(-1, 2)
        signed = own.view("int64")
        return pd.DataFrame({"a": signed[links[:, 0]], "b": signed[links[:, 1]]})

    sent = points.select("fp").mapInPandas(send, "shard long, fp long")
    return sent.groupBy("shard").applyInPandas(search, "a long, b long")


def _classes(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp, text_hash of every row, and fp, component (smallest fingerprint), component_id."""
    require(docs, "doc_id", "text")
    printed = stored(docs.select("doc_id", _fingerprint(text_of()).alias("fp"), F.xxhash64(text_of()).alias("text_hash")), "simhash")
    points = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-points")
    groups = connected_components(fingerprint_links(points, radius)).select(F.col("node").alias("fp"), "component")
    named = points.join(groups, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return printed, stored(named.join(least, "component").select("fp", "component", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component, component_id of every row: the smallest fingerprint and the smallest doc_id
    reachable over links."""
    printed, classes = _classes(docs, radius)
    return printed.join(classes, "fp").select("doc_id", "fp", "component", "component_id")


def unique_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group: the one with the smallest ``doc_id``; of repeated rows one stays.

    Groups are told apart by their component, not by an id: groups without any ``doc_id`` keep one row
    each, and so do groups whose smallest ids are equal.
    """
    printed, classes = _classes(docs, radius)
    spot = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "text_hash")
    first = printed.join(classes, "fp").groupBy("component").agg(F.min(spot).alias("first"))
    chosen = first.select("component", F.col("first.doc_id").alias("keep_id"), F.col("first.text_hash").alias("keep_hash"))
    own = docs.select(carried(docs), "doc_id", F.xxhash64(text_of()).alias("own_hash"))
    hit = own.join(chosen, own["doc_id"].eqNullSafe(chosen["keep_id"]) & (own["own_hash"] == chosen["keep_hash"]))
    return hit.dropDuplicates(["component"]).select("row.*")
