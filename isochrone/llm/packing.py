"""Best-fit packing of token pieces into fixed-length sequences by bin completion.

1. ``pieces`` tokenises every document inside its task and cuts only what is longer than a sequence.
2. The packing problem depends on the piece lengths alone, and there are at most ``capacity`` of them:
   one count per length is all the solver sees, for any number of documents.
3. ``solve`` is branch and bound. A node takes the largest piece left, enumerates the undominated
   fillings of the room beside it, and applies one as often as the counts allow. A branch ends when its
   waste exceeds what the wanted number of sequences leaves; best-fit decreasing gives the incumbent.
   The search stops at the lower bound or after ``EFFORT`` steps, and then returns the best it has: every
   piece is packed in any case.
4. Pieces of a length are numbered (counts per hash bucket, then row numbers inside a bucket, so a
   length shared by a third of all rows is spread over many tasks) and the number says where it goes.

Tokens of a text without white space inside words do not depend on its neighbours: the tokenizer drops
white space, and neither its normaliser nor its pattern looks across it. So ids are kept per run of
non-space characters in a bounded table of the worker, and texts are assembled from them.

Defined results: a NULL or empty text is one piece holding the closing id only; repeated rows are packed
each on its own; a NULL ``doc_id`` is a document like any other; an empty table gives no pieces; other
columns are not read. Texts of any length are handled whole, in pieces of ``capacity``.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import require, stored, text_of

CAPACITY = 2048
END_ID = 0
#: Runs of characters whose ids a worker keeps in each of two generations.
KNOWN_RUNS = 400_000
#: Steps of the branch-and-bound search.
EFFORT = 1_500_000
#: Rows of a length that one task numbers, on average.
BUCKET_ROWS = 2048

_encoders: dict[str, _Encoder] = {}


class _Encoder:
    """Ids of runs of non-space characters, remembered in two generations: when the newer one is full it
    replaces the older, so runs in steady use stay and memory is bounded."""

    PUNCTUATION = b".,;:!?*#$%&|()-"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a unit of the pre-tokenizer.
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.closing[i] = token.endswith("</w>")
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _split(self, run: bytes) -> tuple[bytes, bytes]:
        """Letters and the punctuation after them, which have their own ids; else the run and nothing."""
        core = run.rstrip(self.PUNCTUATION)
        if core.isalpha():  # ASCII letters
            return core.lower(), run[len(core) :]
        if len(core) < len(run) and core.decode("utf-8", "replace").isalpha():
            return core, run[len(core) :]
        return run, b""

    def _encode(self, parts: list[bytes]) -> None:
        texts = [p.decode("utf-8", "replace") for p in parts]
        words = [i for i, t in enumerate(texts) if t.isalpha()]
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            blocks = [some[i : i + 64] for i in range(0, len(some), 64)]
            for block, e in zip(blocks, self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in b) for b in blocks], add_special_tokens=False), strict=True):
                # a word of letters is one unit, and only the last token of a unit is marked as its end
                ids = np.asarray(e.ids, "<u4")
                ends = np.flatnonzero(self.closing[ids]) + 1
                if len(ends) != len(block) or ends[-1] != len(ids):
                    self._encode_each([parts[i] for i in block])
                    continue
                data, first = ids.tobytes(), 0
                for i, end in zip(block, (4 * ends).tolist(), strict=True):
                    self.new[parts[i]] = data[first:end]
                    first = end
        letters = set(words)
        self._encode_each([p for i, p in enumerate(parts) if i not in letters])

    def _encode_each(self, parts: list[bytes]) -> None:
        for i in range(0, len(parts), 4096):
            some = parts[i : i + 4096]
            for part, e in zip(some, self.tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in some], add_special_tokens=False), strict=True):
                self.new[part] = np.asarray(e.ids, "<u4").tobytes()

    def learn(self, runs: set[bytes]) -> None:
        new, old = self.new, self.old
        missing = []
        for r in runs.difference(new):
            ids = old.get(r)
            if ids is None:
                missing.append(r)
            else:
                new[r] = ids
        if missing:
            halves = {r: self._split(r) for r in missing}
            parts = {p for pair in halves.values() for p in pair if p}.difference(new)
            for p in [p for p in parts if p in old]:
                new[p] = old[p]
                parts.discard(p)
            self._encode(list(parts))
            for r, (core, rest) in halves.items():
                if rest or r != core:
                    new[r] = new[core] + (new[rest] if rest else b"")
        if len(new) > KNOWN_RUNS:
            self.old, self.new = new, {r: new[r] for r in runs}


def encode_texts(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    encoder = _encoders[path]
    for text in texts:
        runs = text.encode("utf-8", "surrogatepass").split()
        try:
            yield b"".join(map(encoder.new.__getitem__, runs))
        except KeyError:
            encoder.learn(set(runs))
            yield b"".join(map(encoder.new.__getitem__, runs))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ``ids``): every document's ids and the closing
    id, cut into pieces of ``capacity`` where longer."""
    require(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, data in zip(frame["doc_id"], encode_texts(frame["text"].tolist(), tokenizer_path), strict=True):
                data += END_ID.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for k, v in (("doc_id", doc_id), ("piece", piece), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                        out[k].append(v)
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype("int32"))
            if not with_ids:
                del out["ids"]
            yield pd.DataFrame(out)

    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    # the id travels as text: NULL ids would turn whole numbers into floating point
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text")).mapInPandas(run, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: pieces over half the room stand apart, and what does not fit
    beside them needs sequences of its own (for every threshold of small pieces)."""
    total = sum(x * n for x, n in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for k in [0, *[x for x in lengths if x <= capacity // 2]]:
        alone = sum(n for x, n in counts.items() if x > capacity - k)
        large = [(x, n) for x, n in counts.items() if capacity // 2 < x <= capacity - k]
        room = sum((capacity - x) * n for x, n in large)
        small = sum(x * n for x, n in counts.items() if k <= x <= capacity // 2)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over counts: (filling as (length, how often) pairs, sequences) entries."""
    open_bins: dict[int, list[list]] = {}  # room left -> [filling, how many such sequences]
    for x in sorted(counts, reverse=True):
        left = counts[x]
        moved: list[tuple[int, tuple, int]] = []
        for room in sorted(r for r in open_bins if r >= x):
            fits = room // x
            while left and open_bins[room]:
                filling, n = open_bins[room][-1]
                whole = min(n, left // fits)
                if whole:
                    moved.append((room - fits * x, (*filling, (x, fits)), whole))
                    left -= whole * fits
                elif left:
                    moved.append((room - left * x, (*filling, (x, left)), 1))
                    whole, left = 1, 0
                open_bins[room][-1][1] -= whole
                if not open_bins[room][-1][1]:
                    open_bins[room].pop()
            if not left:
                break
        fits = capacity // x
        if left // fits:
            moved.append((capacity - fits * x, ((x, fits),), left // fits))
        if left % fits:
            moved.append((capacity - left % fits * x, ((x, left % fits),), 1))
        for room, filling, n in moved:
            open_bins.setdefault(room, []).append([filling, n])
    return [(f, n) for bins in open_bins.values() for f, n in bins]


class _Effort:
    """Steps the search may still take: a bound on its time that is the same on every machine."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self, steps: int = 1) -> bool:
        self.left -= steps
        return self.left > 0


def fillings(counts: dict[int, int], lengths: list[int], room: int, effort: _Effort, most: int = 16, steps: int = 600) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Undominated fillings of ``room`` as (waste, filling), least waste first; ``lengths`` ascending.

    Pieces are tried from the longest; a filling is dominated when a longer piece that is not in it could
    take the place of one or two of its pieces. Enumeration ends after ``most`` fillings or ``steps`` steps.
    """
    found: dict[tuple, int] = {}
    budget = [steps]

    def dominated(filling, waste) -> bool:
        if not waste:
            return False
        used = dict(filling)
        parts = [x for x, n in filling for _ in range(min(n, 2))][-6:]
        for s in {*parts, *(a + b for i, a in enumerate(parts) for b in parts[i + 1 :])}:
            i = bisect.bisect_right(lengths, s)
            while i < len(lengths) and lengths[i] <= s + waste:
                if counts[lengths[i]] > used.get(lengths[i], 0):
                    return True
                i += 1
        return False

    def go(i: int, left: int, filling: tuple) -> bool:
        """Fill ``left`` with lengths up to the i-th; False ends the enumeration."""
        budget[0] -= 1
        i = min(i, bisect.bisect_right(lengths, left) - 1)
        if left == 0 or i < 0:
            if not dominated(filling, left):
                found[filling] = left
            return budget[0] > 0 and len(found) < most and not (left == 0 and len(found) >= 4)
        x = lengths[i]
        for k in range(min(left // x, counts[x]), -1, -1):
            if not go(i - 1, left - k * x, (*filling, (x, k)) if k else filling):
                return False
        return budget[0] > 0

    # an exact partner, or an exact pair of partners, leaves no waste
    at = bisect.bisect_right(lengths, room) - 1
    for i in range(at, max(at - 64, -1), -1):
        x, rest = lengths[i], room - lengths[i]
        if rest == 0:
            found[((x, 1),)] = 0
        elif rest < x and rest in counts:
            found[((x, 1), (rest, 1))] = 0
        elif rest == x and counts[x] > 1:
            found[((x, 2),)] = 0
        if len(found) >= 4:
            break
    if not found:
        go(at, room, ())
    effort.spend(steps - budget[0] + 20 * len(found) + len(lengths) // 8 + 64)
    return sorted(((w, f) for f, w in found.items()), key=lambda p: (p[0], sum(n for _, n in p[1])))


def _search(counts: dict[int, int], capacity: int, allowed: int, effort: _Effort):
    """A packing whose waste is at most ``allowed``, or None when there is none or the effort is spent."""
    left, waste, plan = dict(counts), 0, []

    def options():
        x = max(left)
        left[x] -= 1
        own = {y: n for y, n in left.items() if n}
        left[x] += 1
        found = fillings(own, sorted(own), capacity - x, effort)
        return [x, iter(found or [(capacity - x, ())]), None]

    # an explicit stack of (largest piece, choices still to try, the choice applied)
    stack = [options()]
    while stack and effort.spend():
        x, tries, applied = stack[-1]
        if applied:
            need, times, w = applied
            for y, k in need.items():
                left[y] = left.get(y, 0) + k * times
            waste -= w * times
            plan.pop()
            stack[-1][2] = None
        choice = next(tries, None)
        if choice is None:
            stack.pop()
            continue
        w, filling = choice
        need = dict(filling)
        need[x] = need.get(x, 0) + 1
        times = min(left[y] // k for y, k in need.items())
        if waste + w > allowed:
            continue
        if w:
            times = min(times, (allowed - waste) // w)
        for y, k in need.items():
            left[y] -= k * times
            if not left[y]:
                del left[y]
        waste += w * times
        plan.append((tuple(sorted(need.items(), reverse=True)), times))
        stack[-1][2] = (need, times, w)
        if not left:
            return list(plan)
        stack.append(options())
    return None


def solve(counts: dict[int, int], capacity: int = CAPACITY, effort: int = EFFORT) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Fillings and how many sequences have each, using as few sequences as found."""
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    size_of = lambda plan: sum(n for _, n in plan)
    total = sum(x * n for x, n in counts.items())
    best, bound, budget = best_fit(counts, capacity), lower_bound(counts, capacity), _Effort(effort)
    # one descent without a bound on the waste, then searches that must save at least one sequence
    allowed = capacity * sum(counts.values())
    while size_of(best) > bound:
        plan = _search(counts, capacity, allowed, budget)
        if plan and size_of(plan) < size_of(best):
            best = plan
        elif allowed < size_of(best) * capacity - total:
            break
        allowed = (size_of(best) - 1) * capacity - total
    return best


def _places(plan) -> dict[str, np.ndarray]:
    """For each run of equal places: length, first number, first sequence, how often in it, offset."""
    rows, taken, sequence = [], {}, 0
    for filling, n in plan:
        offset = 0
        for x, k in filling:
            first = taken.get(x, 0)
            rows.append((x, first, sequence, k, offset))
            taken[x] = first + k * n
            offset += x * k
        sequence += n
    table = np.array(sorted(rows), "int64").reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "often", "offset"), table.T, strict=True))


def pack(parts: DataFrame, capacity: int = CAPACITY, effort: int = EFFORT) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; ``parts`` must be a stored table (it is read twice)."""
    spark = parts.sparkSession
    total = parts.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    salted = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counted = stored(salted.groupBy("length", "bucket").agg(F.count("*").alias("n")), "packing-counts")
    # at most one row per length: the whole problem, whatever the number of documents
    lengths = {int(r["length"]): int(r["n"]) for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(solve(lengths, capacity, effort)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("own", F.row_number().over(own) - 1).join(starts, ["length", "bucket"])

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        p = places.value
        key = p["length"].astype("float64") * 2.0**40
        # runs are sorted by (length, first): numbers below 2^40 keep that order inside one key
        if number.max() < 2**40:
            at = np.searchsorted(key + p["first"], length.to_numpy() * 2.0**40 + number.to_numpy(), "right") - 1
        else:
            at = np.array([np.searchsorted(p["length"], x) + np.searchsorted(p["first"][p["length"] == x], n, "right") - 1 for x, n in zip(length, number, strict=True)])
        inside = number.to_numpy() - p["first"][at]
        often = p["often"][at]
        return pd.DataFrame({"sequence_id": p["sequence"][at] + inside // often, "offset": p["offset"][at] + inside % often * length.to_numpy()})

    placed = numbered.withColumn("place", place("length", F.col("before") + F.col("own")))
    return placed.select(*[F.col(c) for c in parts.columns], "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return pack(stored(pieces(docs, tokenizer_path, capacity, with_ids), "packing-pieces"), capacity)
