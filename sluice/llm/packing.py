"""Best-fit packing of token sequences, with a certified number of bins.

Documents become pieces of at most ``SIZE`` tokens.  Pieces are dealt to partitions of about ``SHARE`` pieces by a hash,
each is packed by best-fit decreasing, and dual feasible functions bound from below how many bins its pieces need.
A partition that meets its bound is certified and done.  One with a gap keeps its full bins and hands the pieces of its
other bins to the next round, where partitions with gaps exchange documents: the pieces are dealt anew, over fewer
partitions.  A partition that has no other to exchange with, and every one from the second round on, also tries other orders than the
decreasing one.  Rounds go on until no partition has a gap, the bound of all pieces together is met, or a
round saves no bin.  Only lengths travel; the tokens stay behind as a checksum.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.scratch import Scratch

SIZE = 2048
SHARE = 10_000
#: Orders that a partition with a gap tries besides the decreasing one.
TRIES = 12
#: The two libraries give the same ids but for added tokens; the faster one cannot take longer runs of blanks than some 10^5.
BLANKS = 10_000


def lower_bound(count: np.ndarray) -> int:
    """The greatest bound on bins that a family of dual feasible functions gives for ``count[length]`` pieces of each
    length up to the capacity, ``len(count) - 1``.

    One family, for each k: lengths over capacity - k count as a whole bin, those under k as nothing, others as they
    are.  Another, for each q: lengths are rounded down to multiples of capacity / (q + 1), of which q make a bin; exact multiples
    are left as they are.  Lengths that fit into one bin add up to at most one bin under each, so the sum over all is a bound.
    """
    capacity = len(count) - 1
    value = np.arange(capacity + 1, dtype=np.int64)
    count = count.astype(np.int64)
    number, mass = np.cumsum(count), np.cumsum(count * value)
    k = np.arange(0, capacity // 2 + 1)
    middle = mass[capacity - k] - np.where(k > 0, mass[np.maximum(k - 1, 0)], 0)
    best = int((number[-1] - number[capacity - k] + -(-middle // capacity)).max())
    for q in range(1, 21):
        times = value * (q + 1)
        rounded = np.where(times % capacity == 0, q * value, (times // capacity) * capacity)  # in parts of q * capacity
        best = max(best, -(-int((count * rounded).sum()) // (q * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int = SIZE, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit in the given order (else decreasing): the bin of each size, its offset there, and the free room of each bin."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room
    rooms, free = 0, []  # rooms: bit r is set if a bin has room r
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for i in (np.argsort(-sizes, kind="stable") if order is None else order).tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i], free[b] = b, capacity - room, room - size
        if free[b]:
            open_bins[free[b]].append(b)
            rooms |= 1 << free[b]
    return bins, offsets, np.array(free, dtype=np.int64)


def best_orders(sizes: np.ndarray, capacity: int, bound: int, tries: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing, and while it misses the bound best fit by sizes that are stretched at random, a little more at each try."""
    best, rng = best_fit(sizes, capacity), np.random.default_rng(seed)
    for t in range(tries):
        if len(best[2]) <= bound:
            break
        stretched = sizes * (1 + rng.uniform(-0.5, 0.5, len(sizes)) * (t + 1) / tries)
        found = best_fit(sizes, capacity, np.argsort(-stretched, kind="stable"))
        # Of equally many bins the ones with more full bins: fewer pieces go to the next round.
        if (len(found[2]), -(found[2] == 0).sum()) < (len(best[2]), -(best[2] == 0).sum()):
            best = found
    return best


def _pack_part(capacity: int, tries: int, seed: int):
    """A partition's pieces with bin and offset.  ``gap``: its bins over its bound; ``done``: the piece's bin stands."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "piece_id"])
        sizes = rows["length"].to_numpy()
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1))
        bins, offsets, free = best_orders(sizes, capacity, bound, tries, seed)
        gap = len(free) - bound
        return pd.DataFrame({"piece_id": rows["piece_id"].to_numpy(), "length": sizes, "part": key[0], "bin": bins, "offset": offsets,
                             "gap": gap, "done": (free[bins] == 0) | (gap == 0)})
    return run


def pack(pieces: DataFrame, capacity: int = SIZE, share: int = SHARE, tries: int = TRIES) -> tuple[DataFrame, dict]:
    """(piece_id, sequence_id, offset) of each piece (piece_id unique, 0 < length <= capacity), and what certifies it:
    ``bins``, ``lower_bound`` of all pieces together, and ``rounds``, the bins after each round.
    """
    keep = Scratch(pieces.sparkSession, "packing")
    todo = keep.keep(pieces.select("piece_id", F.col("length").cast("long").alias("length")))
    count = np.zeros(capacity + 1, dtype=np.int64)
    for r in todo.groupBy("length").count().collect():  # one row for each length up to the capacity
        count[r["length"]] = r["count"]
    bound, settled, n = lower_bound(count), int(count[capacity]), int(count[1:capacity].sum())
    # A piece of full length is a bin of its own.
    out = [todo.where(F.col("length") == capacity).select("piece_id", F.xxhash64(F.lit(-1), "piece_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    todo, loose, kept, history, k = todo.where(F.col("length") < capacity), None, None, [], 0
    while True:
        parts = max(1, -(-n // share))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("piece_id", F.lit(k)), F.lit(parts)))
        packed = keep.keep(dealt.groupBy("part").applyInPandas(
            _pack_part(capacity, tries if k or parts == 1 else 0, k), "piece_id long, length long, part long, bin long, offset long, gap long, done boolean"))
        total, closed, gaps = packed.select("part", "bin", "gap", "done").distinct().agg(
            F.count("*"), F.coalesce(F.sum(F.col("done").cast("long")), F.lit(0)), F.coalesce(F.max("gap"), F.lit(0))).first()
        place = packed.select("piece_id", F.xxhash64(F.lit(k), "part", "bin").alias("sequence_id"), "offset", "length", "done")
        if loose is not None and total >= loose:
            break  # the exchange saved nothing: the round before stands
        history.append(settled + total)
        if kept is not None:
            out.append(kept.where("done"))
        kept, loose = place, total - closed
        if gaps == 0 or settled + total <= bound:
            break
        settled += closed
        todo = place.where("NOT done").select("piece_id", "length")
        n, k = max(1, todo.count()), k + 1
    if kept is not None:
        out.append(kept)
    placed = out[0]
    for o in out[1:]:
        placed = placed.unionByName(o.select("piece_id", "sequence_id", "offset"))
    return placed, {"bins": history[-1] if history else settled, "lower_bound": bound, "rounds": history}


def encoder(tokenizer_json: str, ranks_file: bytes = b"", pattern: str = ""):
    """Text to ids as ``tokenizers`` gives them with add_special_tokens=False.

    With the ranks of the same vocabulary, texts take the faster library, but for those that hold an added token or a long run of blanks.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_str(tokenizer_json)

    def slow(text: str) -> list[int]:
        return exact.encode(text, add_special_tokens=False).ids
    if not ranks_file:
        return slow
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
    fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])]
    unlike = re.compile("|".join([r"(?<!\s)\s{%d}" % BLANKS, *map(re.escape, added)]))
    return lambda text: slow(text) if unlike.search(text) else fast(text)


def _cut(tokenizer_json: str, ranks_file: bytes, pattern: str, end_id: int, capacity: int):
    """(doc_id, piece, start, length, ids_crc32) of the pieces of each document."""
    def run(batches):
        encode = encoder(tokenizer_json, ranks_file, pattern)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                tokens = [*encode(text.as_py() or ""), end_id]
                data, n = memoryview(np.array(tokens, dtype="<u4").tobytes()), len(tokens)
                # Only the first piece may be shorter than the capacity.
                start, end, piece = 0, n % capacity or min(n, capacity), 0
                while start < n:
                    rows.append((doc, piece, start, end - start, zlib.crc32(data[4 * start:4 * end])))
                    start, end, piece = end, end + capacity, piece + 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str = "", pattern: str = "", end_id: int = 0, capacity: int = SIZE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, bins, bins_at_least) of each piece of each row of ``docs``.

    A document's ids are those that ``tokenizers`` gives by the file at ``tokenizer_path``, without adding any, and then ``end_id``.  ``ranks_path`` and
    ``pattern`` may name the same vocabulary for tiktoken, which is faster (both files are read once, on the driver; about 2 MB go to
    each task).  Documents longer than ``capacity`` are cut, the first piece taking the odd length.  ``bins`` is the number of
    sequences, ``bins_at_least`` the certified lower bound.  A null or empty text is the end id alone.  Repeated rows
    and rows without id are packed each by itself.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    ranks = b""
    if ranks_path:
        with open(ranks_path, "rb") as f:
            ranks = f.read()
    keep = Scratch(docs.sparkSession, "pieces")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = source.mapInArrow(_cut(tokenizer_json, ranks, pattern, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = keep.keep(pieces.withColumn("piece_id", F.monotonically_increasing_id()))
    placed, sure = pack(pieces, capacity)
    return pieces.join(placed, "piece_id").drop("piece_id").withColumns(
        {"bins": F.lit(sure["bins"]).cast("long"), "bins_at_least": F.lit(sure["lower_bound"]).cast("long")})
