"""Document fingerprints from content-defined chunks.

A gear hash (each byte's random value, shifted by its distance) is taken at every byte; a chunk ends where its top bits are
zero.  Cutting is normalised: below the expected length more bits must be zero, above it fewer, so lengths
stay close to ``AVERAGE``.  An edit changes the chunks it touches and the text around them keeps its own.  The
fingerprint lists the distinct chunks' digests with their lengths; likeness is the weight of the shared chunks over that of the
smaller set (containment).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.arrays import mix
from sluice.llm.scratch import Scratch

SHORTEST, AVERAGE, LONGEST = 32, 128, 512
#: Zero bits that end a chunk below and above the expected length.
STRICT, LOOSE = 9, 5
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    h, size = _GEAR[np.frombuffer(data, dtype=np.uint8)], 1
    while size < 32:  # the hash of 32 bytes from those of 1, 2, 4, ...
        h[size:] = h[size:] + (h[:-size] << np.uint32(size)) if len(h) > size else h[size:]
        size *= 2
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE))) + 1
    strict = loose[h[loose - 1] < np.uint32(1 << (32 - STRICT))].tolist()
    loose, out, start = loose.tolist(), [], 0
    while start < n:
        end = min(n, start + LONGEST)
        if n - start > SHORTEST:
            i = bisect_left(strict, start + SHORTEST)
            if i < len(strict) and strict[i] < start + AVERAGE:
                end = strict[i]
            else:
                i = bisect_left(loose, start + AVERAGE)
                if i < len(loose) and loose[i] < end:
                    end = loose[i]
        out.append(end)
        start = end
    return out


def chunk_set(text: str) -> dict[int, int]:
    """Digest and length of each distinct chunk, in order of first appearance."""
    data, start, out = text.encode(), 0, {}
    for end in cuts(data):
        piece = data[start:end]
        out.setdefault(xxhash.xxh3_64_intdigest(piece), end - start)
        start = end
    return out


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Length of the shared chunks over that of the smaller set; of two empty sets 1, of one 0."""
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    shared = sum(n for d, n in small.items() if d in large)
    return shared / min(sum(a.values()), sum(b.values()))


def printed(s: dict[int, int]) -> str:
    return " ".join(f"{d:016x}{n:x}" for d, n in s.items())


RESULT = [("doc_id", pa.int64(), "long"), ("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"), ("fingerprint", pa.string(), "string"),
          ("edited_fingerprint", pa.string(), "string"), ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double")]
#: The result as it is written: both fingerprints together, which share most chunks, compressed.
STORED = [c for c in RESULT if "fingerprint" not in c[0]] + [("prints", pa.binary(), "binary")]
#: Which end of which range a row is (0 none, 1 first, 2 last), and that row's text.
ENDS = [("part", pa.int32(), "int"), ("border", pa.int32(), "int"), ("text", pa.string(), "string")]


def _schema(columns) -> str:
    return ", ".join(f"{name} {spark}" for name, _, spark in columns)


def _batch(rows: list[tuple], columns) -> pa.RecordBatch:
    cells = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind, _) in zip(cells, columns, strict=True)], names=[name for name, _, _ in columns])


def _stored(row: tuple, zipped) -> tuple:
    doc, n, digest, prints, edited, near_edited, near_next = row
    return doc, n, digest, near_edited, near_next, zipped(f"{prints}\n{edited}".encode())


def _readable(batches):
    unzipped = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        both = [unzipped(p).decode().split("\n") for p in batch.column("prints").to_pylist()]
        cells = {"fingerprint": pa.array([b[0] for b in both], pa.string()), "edited_fingerprint": pa.array([b[1] for b in both], pa.string())}
        yield pa.RecordBatch.from_arrays([cells[name] if name in cells else batch.column(name) for name, _, _ in RESULT], names=[name for name, _, _ in RESULT])


def compared(doc: int | None, old: str, after: str, old_prints: dict | None = None, after_prints: dict | None = None) -> tuple:
    """A document's result row, given the text of the next one."""
    old_prints = chunk_set(old) if old_prints is None else old_prints
    after_prints = chunk_set(after) if after_prints is None else after_prints
    n = len(old)
    k = n // 4
    edited = old[:n - k] + after[:k]
    edited_prints = chunk_set(edited)
    return (doc, n, hashlib.sha256(edited.encode()).hexdigest(), printed(old_prints), printed(edited_prints),
            likeness(old_prints, edited_prints), likeness(old_prints, after_prints))


def _compare_range(batches):
    """A range of rows in order: each document against the next one; the range's first and last row are handed on."""
    part, held, rows = TaskContext.get().partitionId(), None, []
    none, zipped = (None,) * len(STORED), zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            prints = chunk_set(text)
            if held is None:
                rows.append((*none, part, 1, text))
            else:
                rows.append((*_stored(compared(held[0], held[1], text, held[2], prints), zipped), part, 0, None))
            held = (doc, text, prints)
            if len(rows) >= 500:
                yield _batch(rows, STORED + ENDS)
                rows = []
    if held is not None:
        rows.append((held[0], *none[1:], part, 2, held[1]))
        yield _batch(rows, STORED + ENDS)


def _compare_borders(batches):
    for batch in batches:
        rows = [compared(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True)]
        yield _batch(rows, RESULT)


def in_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in order, in ranges cut at quantiles; rows that are alike may part anywhere."""
    order = ["doc_id", "h", "row"]  # ascending, nulls first
    rows = docs.withColumns({"h": F.xxhash64("text"), "row": F.xxhash64(F.monotonically_increasing_id())})
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def compare_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The next document is the one with the next higher id (after the last: the first); equal ids go by the texts' xxhash64,
    rows without id come before all.  The edited text has its last floor(n_chars / 4) code points
    replaced by the first as many of the next document (all, if it is shorter).  A null text is empty; its fingerprint is the empty string.

    Rows are sorted into ranges that Spark cuts at quantiles of (id, text hash, a number of the row), so neither ids far apart nor
    many rows under one id, without id, or alike fill one range.  A range compares its own neighbours and hands on its first and last row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keep = Scratch(spark, "fingerprints")
    found = keep.keep(in_ranges(docs).mapInArrow(_compare_range, _schema(STORED + ENDS)))
    parts = sorted(r["part"] for r in found.where("border = 1").select("part").collect())  # one number a range
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, following int")
    firsts = found.where("border = 1").select(F.col("part").alias("following"), F.col("text").alias("after"))
    lasts = found.where("border = 2").select("part", "doc_id", "text").join(follows, "part").join(firsts, "following")
    borders = lasts.select("doc_id", "text", "after").mapInArrow(_compare_borders, _schema(RESULT))
    return found.where("border = 0").select(*(name for name, _, _ in STORED)).mapInArrow(_readable, _schema(RESULT)).unionByName(borders)
