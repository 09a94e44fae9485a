"""Token ids in binary files of patched frame-of-reference blocks, written and read back by Spark tasks.

1. Documents are dealt by ranges of ``doc_id`` and sorted inside; a task tokenises its own and writes one file.
   Equal ids may be split between files: the order continues with a hash of the text and a number of the row,
   so a hot id, or all rows without one, fills as many files as it needs.
2. Ids are stored in blocks of ``BLOCK``. A block keeps its minimum, and the differences from it at the
   width that ``PERCENTILE`` percent of them need, in four interleaved lanes; the few that need more stand in the
   block's exception list (places, then whole differences). The index has minimum, width, number of exceptions
   and start of every block, so any document is found and decoded without the ids before it.
3. The manifest lists the files that finished tasks returned, with the number of ids before each. A repeated task
   writes a new file; what a lost attempt left is never read.

A file: magic; blocks; index (block starts, minima, widths, exception counts, ids per document, document
ids); footer (documents, blocks, ids, place of the index, magic). All numbers are little-endian. Files are
opened through ``pyarrow.fs`` by the executors, under the shared folder or any place it can open.

Defined results: a NULL or empty text is the closing id alone; rows without ``doc_id`` come last; repeated rows
and repeated ids are kept, ordered by a hash of their text; an empty table writes no file and reads as an empty
result; columns beside ``doc_id`` and ``text`` are not read. Texts of any length are written whole; memory
holds a step of blocks and the index of one file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spark import shared_dir
from .common import require, stored, text_of
from .packing import encode_texts

END_ID = 1
BLOCK, LANES = 128, 4
#: Share of a block's values whose width the block is packed at.
PERCENTILE = 90
#: Bytes of text that go to one file, on average.
FILE_BYTES = 64 << 20
#: Blocks that are encoded or decoded at once.
STEP = 2048
#: Files whose sizes are added up together.
FILE_GROUP = 1024

MAGIC = b"PFORIDS1"
FOOTER = struct.Struct("<QQQQ8s")
MANIFEST = "part int, file string, documents long, blocks long, tokens long, bytes long"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` numbers below 2 ** width as rows of 16 * width bytes."""
    lanes = values.reshape(len(values), BLOCK // LANES, LANES)
    out = np.zeros((len(values), width, LANES), "<u4")
    for i in range(BLOCK // LANES):
        word, shift = divmod(i * width, 32)
        out[:, word] |= lanes[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= lanes[:, i] >> np.uint32(32 - shift)
    return out.reshape(len(values), -1).view("uint8")


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(data).view("<u4").reshape(len(data), width, LANES)
    out = np.empty((len(data), BLOCK // LANES, LANES), "uint32")
    mask = np.uint32(2**width - 1)
    for i in range(BLOCK // LANES):
        word, shift = divmod(i * width, 32)
        x = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | words[:, word + 1] << np.uint32(32 - shift)
        out[:, i] = x & mask
    return out.reshape(len(data), BLOCK)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the blocks of some ids (the last one filled up), and size, minimum, width and number of
    exceptions of each."""
    short = -len(ids) % BLOCK
    rows = np.concatenate([ids, np.full(short, ids[-1], "uint32")]).reshape(-1, BLOCK)
    low = rows.min(axis=1)
    over = rows - low[:, None]
    at = -(-BLOCK * PERCENTILE // 100) - 1
    width = np.frexp(np.partition(over, at, axis=1)[:, at].astype("float64"))[1].astype("int64")
    limit = (np.uint64(1) << width.astype("uint64")) - np.uint64(1)
    row, place = np.nonzero(over > limit[:, None].astype("uint32"))
    exceptions = np.bincount(row, minlength=len(rows))
    size = 16 * width + 5 * exceptions
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), "uint8")
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            out[start[own][:, None] + np.arange(16 * w)] = _pack(over[own] & np.uint32(2**w - 1), w)
    # places first, then the differences
    nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    begin = start[row] + 16 * width[row]
    out[begin + nth] = place
    out[(begin + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = over[row, place].astype("<u4").view("uint8").reshape(-1, 4)
    return out.tobytes(), size, low, width.astype("uint8"), exceptions.astype("uint8")


def decode_blocks(data: np.ndarray, start: np.ndarray, low: np.ndarray, width: np.ndarray, exceptions: np.ndarray) -> np.ndarray:
    """The ids of some blocks that stand one after another in ``data``; ``start`` counts from its beginning."""
    out = np.zeros((len(start), BLOCK), "uint32")
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            out[own] = _unpack(data[start[own][:, None] + np.arange(16 * w)], w)
    row = np.repeat(np.arange(len(start)), exceptions)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions, dtype="int64") - exceptions, exceptions)
        begin = start[row] + 16 * width[row].astype("int64")
        place = data[begin + nth]
        out[row, place] = data[(begin + exceptions[row] + 4 * nth)[:, None] + np.arange(4)].view("<u4").ravel()
    out += low[:, None]
    return out.ravel()


class Writer:
    """One file, written from front to back."""

    def __init__(self, sink):
        self.sink, self.held, self.waiting = sink, [], 0
        self.size, self.low, self.width, self.exceptions = [], [], [], []
        self.lengths, self.names = [], []
        self.sink.write(MAGIC)

    def add(self, doc_id: str | None, data: bytes) -> None:
        """The ids of a document, as little-endian 32-bit numbers."""
        self.names.append(doc_id)
        self.lengths.append(len(data) // 4)
        self.held.append(data)
        self.waiting += len(data)
        if self.waiting >= 4 * BLOCK * STEP:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.held)
        full = len(data) if last else len(data) - len(data) % (4 * BLOCK)
        self.held, self.waiting = [data[full:]], len(data) - full
        ids = np.frombuffer(data, "<u4", full // 4)
        for at in range(0, len(ids), BLOCK * STEP):
            body, size, low, width, exceptions = encode_blocks(ids[at : at + BLOCK * STEP])
            self.sink.write(body)
            for own, part in ((self.size, size), (self.low, low), (self.width, width), (self.exceptions, exceptions)):
                own.append(part)

    def close(self) -> tuple[int, int, int, int]:
        """Write index and footer; documents, blocks, ids and bytes of the file."""
        self._flush(True)
        joined = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)
        size = joined(self.size, "<i8")
        names = [b"" if n is None else n.encode() for n in self.names]
        widths = np.array([-1 if n is None else len(b) for n, b in zip(self.names, names, strict=True)], "<i4")
        index = [(len(MAGIC) + np.cumsum(size) - size).astype("<u8"), joined(self.low, "<u4"), joined(self.width, "u1"), joined(self.exceptions, "u1"), np.array(self.lengths, "<u8"), widths]
        body = b"".join([*(x.tobytes() for x in index), *names])
        at, tokens = len(MAGIC) + int(size.sum()), sum(self.lengths)
        self.sink.write(body)
        self.sink.write(FOOTER.pack(len(names), len(size), tokens, at, MAGIC))
        self.sink.close()
        return len(names), len(size), tokens, at + len(body) + FOOTER.size


class Reader:
    """Random access to one file."""

    def __init__(self, source):
        self.source, self.bytes = source, source.size()
        documents, blocks, self.tokens, at, magic = FOOTER.unpack(source.read_at(FOOTER.size, self.bytes - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids, or cut short")
        self.index_at = at
        body = source.read_at(self.bytes - FOOTER.size - at, at)
        place = 0
        columns = []
        for kind, n in (("<u8", blocks), ("<u4", blocks), ("u1", blocks), ("u1", blocks), ("<u8", documents), ("<i4", documents)):
            columns.append(np.frombuffer(body, kind, n, place))
            place += columns[-1].nbytes
        self.start, self.low, self.width, self.exceptions, self.lengths, widths = columns
        self.ends = np.cumsum(self.lengths, dtype="int64")
        self.names = []
        for w in widths.tolist():
            self.names.append(None if w < 0 else body[place : place + w].decode())
            place += max(w, 0)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` up to ``end`` of the file; reads only the blocks they are in."""
        if end <= begin:
            return np.zeros(0, "uint32")
        a, b = begin // BLOCK, -(-end // BLOCK)
        at = int(self.start[a])
        stop = int(self.start[b]) if b < len(self.start) else self.index_at
        data = np.frombuffer(self.source.read_at(stop - at, at), "uint8")
        ids = decode_blocks(data, self.start[a:b].astype("int64") - at, self.low[a:b], self.width[a:b], self.exceptions[a:b])
        return ids[begin - a * BLOCK : end - a * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i] - self.lengths[i]), int(self.ends[i]))

    def documents(self, with_ids: bool = False) -> Iterator[tuple]:
        """(id, ids before it, number, CRC-32, ids or None) of every document; decodes each block once."""
        held, base = np.zeros(0, "<u4"), 0  # decoded ids from number ``base`` on
        for name, end, n in zip(self.names, self.ends.tolist(), self.lengths.tolist(), strict=True):
            crc, parts, at = 0, [], end - n
            while at < end:
                if at >= base + len(held):
                    base = at // BLOCK * BLOCK
                    held = self.ids(base, min(base + BLOCK * STEP, self.tokens)).astype("<u4", copy=False)
                part = held[at - base : end - base]
                crc = zlib.crc32(part, crc)
                if with_ids:
                    parts.append(part)
                at += len(part)
            yield name, end - n, n, crc, np.concatenate(parts) if with_ids and parts else None


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents in ascending ``doc_id``; the manifest: part, file, documents, blocks, tokens, bytes
    and ``start`` (ids in the files before)."""
    require(docs, "doc_id", "text")
    folder = folder or shared_dir(docs.sparkSession, "token-files")
    rows = docs.select("doc_id", text_of().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // file_bytes))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, writer, name = TaskContext.get().partitionId(), None, None
        for frame in frames:
            if writer is None and len(frame):
                system, path = _files(folder)
                system.create_dir(path, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.pfor"
                writer = Writer(system.open_output_stream(f"{path}/{name}"))
            for doc_id, data in zip(frame["doc_id"], encode_texts(frame["text"].tolist(), tokenizer_path), strict=True):
                writer.add(doc_id, data + END_ID.to_bytes(4, "little"))
        if writer is not None:
            yield pd.DataFrame([(part, f"{folder.rstrip('/')}/{name}", *writer.close())], columns=["part", "file", "documents", "blocks", "tokens", "bytes"])

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    # the number of a row only parts equal rows
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *order, F.col("row").asc())
    own = dealt.sortWithinPartitions(*order, "row").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    files = stored(own.mapInPandas(write, MANIFEST), "token-manifest")
    group = F.floor(F.col("part") / FILE_GROUP)
    sums = files.groupBy(group.alias("group")).agg(F.sum("tokens").alias("n"))
    # one row per FILE_GROUP files
    sums = sums.select("group", F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(files.withColumn("group", group).join(sums, "group").withColumn("start", F.col("before") + inside).drop("group", "before"), "token-manifest")


def read_files(spark: SparkSession, manifest: DataFrame, doc_id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (and the ``ids``) of every document in
    the files of a manifest."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        for frame in frames:
            for path, start in zip(frame["file"], frame["start"], strict=True):
                system, inner = _files(path)
                with system.open_input_file(inner) as source:
                    rows, held = [], 0
                    for name, at, n, crc, ids in Reader(source).documents(with_ids):
                        rows.append((name, start + at, n, crc, *([ids.astype("int64")] if with_ids else [])))
                        held += n if with_ids else 1
                        if held >= 1 << 16:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=columns)

    schema = "doc_id string, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    listed = manifest.select("file", "start")
    rows = listed.repartition(max(1, listed.count())).mapInPandas(read, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast(doc_id_type))
