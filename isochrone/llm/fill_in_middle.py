"""Fill-in-the-middle rearrangement of texts, cuts located by memoised content-defined chunks.

A text is a row of units: runs of the letters A-Z and a-z, and single other characters. A document is cut
before two of its units into prefix, middle and suffix, and written in an order that puts the middle last.

1. A rolling hash over the last ``WINDOW`` bytes cuts the UTF-8 text where its low bits are zero, so equal
   passages fall into equal chunks wherever they stand. Chunks have at most ``LONGEST`` bytes and never
   split a character.
2. A worker keeps one summary per chunk: units, characters, and whether its first and last characters
   are letters. Chunks are looked up by their bytes, so equal hashes of unlike chunks cannot meet. The table
   has two generations of ``KNOWN_CHUNKS`` entries: chunks in steady use stay and memory is bounded.
3. Summaries of neighbours combine: a run of letters that crosses a border is one unit, so the later chunk
   starts one unit less. Running counts give the units of the text and the chunk in which a cut falls; only
   that chunk is read.

The work of a row needs no other row: there is no shuffle, and hot groups cost what their rows cost.

Defined results: a NULL text is empty, has no units and stays plain; a NULL ``doc_id`` draws like the empty
string; repeated rows are cut alike; a text with one of the marks stays plain; an empty table gives an empty
result; ``transform`` reads ``doc_id`` and ``text`` only, so no other column can clash. Texts of any length
are handled whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import require, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that the rolling hash sees (a power of two), and the bits that are zero where a chunk ends.
WINDOW = 32
BORDER_BITS = 9
LONGEST = 4096
KNOWN_CHUNKS = 100_000
#: Bytes that are hashed at once, and bytes of output in one batch.
STEP = 1 << 20
BATCH_BYTES = 32 << 20

_UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xBF][\x80-\xBF]*")
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype="uint32")
_FOLLOWING = bytes(range(0x80, 0xC0))
#: Letters as "a", all other characters as "."; bytes within a character are left out.
_KINDS = bytes(ord("a") if chr(b).isalpha() and b < 128 else ord(".") for b in range(256))


def borders(data: bytes) -> list[int]:
    """Ends of the chunks of a UTF-8 text, ascending; the last is its length."""
    size = len(data)
    if size <= LONGEST // 8:
        return [size] if size else []
    found = []
    for at in range(0, size, STEP):
        # bytes before the step that the window of its first byte covers
        lead = min(at, WINDOW - 1)
        h = _GEAR[np.frombuffer(data, "uint8", min(STEP, size - at) + lead, at - lead)]
        reach = 1
        while reach < WINDOW:
            h[reach:] += h[:-reach] << np.uint32(reach)
            reach *= 2
        # high bits depend on the whole window
        ends = np.flatnonzero(h[lead:] >> np.uint32(32 - BORDER_BITS) == 0) + at + 1
        found += ends.tolist()
    out, last = [], 0
    for end in [*found, size]:
        while end - last > LONGEST:
            last = _whole(data, last + LONGEST - 4)
            out.append(last)
        end = _whole(data, end)
        if end > last:
            out.append(end)
            last = end
    return out


def _whole(data: bytes, at: int) -> int:
    """The next place that does not split a character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """Units, characters, whether the chunk starts and whether it ends with a letter."""
    kinds = chunk.translate(_KINDS, _FOLLOWING)
    first, last = kinds[:1] == b"a", kinds[-1:] == b"a"
    return kinds.count(b".") + kinds.count(b".a") + first, len(kinds), first, last


class Memo:
    """Summaries of chunks by content, in two generations."""

    def __init__(self, size: int = KNOWN_CHUNKS):
        self.size, self.new, self.old = size, {}, {}

    def of(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        known = self.new.get(chunk)
        if known is None:
            known = self.old.get(chunk) or summary(chunk)
            if len(self.new) >= self.size:
                self.old, self.new = self.new, {}
            self.new[chunk] = known
        return known


class Cuts:
    """Counts of one text: ``n`` units, and the place where a unit starts."""

    def __init__(self, data: bytes, memo: Memo):
        self.data, self.ends = data, borders(data)
        self.units, self.chars, self.goes_on = [], [], []
        units = chars = start = 0
        letter = False
        for end in self.ends:
            u, c, first, last = memo.of(data[start:end])
            joined = letter and first
            units, chars, letter, start = units + u - joined, chars + c, last, end
            self.units.append(units)
            self.chars.append(chars)
            self.goes_on.append(joined)
        self.n = units

    def start(self, unit: int) -> tuple[int, int]:
        """Bytes and characters before the unit with this number, from 0; ``n`` stands for the end."""
        if unit >= self.n:
            return len(self.data), self.chars[-1] if self.chars else 0
        i = bisect_left(self.units, unit + 1)
        before = self.units[i - 1] if i else 0
        begin, chars = (self.ends[i - 1], self.chars[i - 1]) if i else (0, 0)
        at = begin
        for skipped, m in enumerate(_UNIT.finditer(self.data, begin, self.ends[i])):
            if skipped == unit - before + self.goes_on[i]:
                at = m.start()
                break
        part = self.data[begin:at]
        return at, chars + len(part.translate(None, _FOLLOWING))


def arranged(data: bytes, n: int, first: tuple[int, int], second: tuple[int, int], spm: bool) -> bytes:
    """The marked text of a document cut at two places."""
    prefix, middle, suffix = data[: first[0]], data[first[0] : second[0]], data[second[0] :]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join([s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, seed: int = 1, rearranged: int = 90, suffix_first: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of every document.

    ``rearranged`` percent of the documents are cut, ``suffix_first`` percent of these in the order
    suffix, prefix, middle (``spm``), the others in the order prefix, suffix, middle (``psm``).
    """
    require(docs, "doc_id", "text")
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    fields = [docs.select(F.col("doc_id")).schema[0]]
    fields += [T.StructField(n, t) for n, t in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            begun, held, rows = 0, 0, []
            texts = batch.column(1).cast(pa.large_binary())
            numbers = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]

            def made(upto, batch=batch):
                columns = [batch.column(0).slice(begun, upto - begun)]
                columns += [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

            for i in range(batch.num_rows):
                data = texts[i].as_py()
                cuts = Cuts(data, memo)
                h1, h2, h3, h4 = (int(x[i]) for x in numbers)
                if not data or h3 % 100 >= rearranged or any(m in data for m in marks):
                    row = (cuts.n, "plain", None, None, data)
                else:
                    first, second = (cuts.start(k) for k in sorted((h1 % (cuts.n + 1), h2 % (cuts.n + 1))))
                    spm = h4 % 100 < suffix_first
                    row = (cuts.n, "spm" if spm else "psm", first[1], second[1] - first[1], arranged(data, cuts.n, first, second, spm))
                rows.append((*row[:4], row[4].decode("utf-8", "replace")))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield made(i + 1)
                    begun, held, rows = i + 1, 0, []
            if rows:
                yield made(batch.num_rows)

    return docs.select("doc_id", text_of().alias("text"), *draws(F.col("doc_id"), seed)).mapInArrow(run, T.StructType(fields))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: marks stand nowhere else in a rearranged one."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.concat(part(1), part(3), part(2)))
