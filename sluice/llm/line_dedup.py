"""Line dedup by pairwise alignment.

Of two documents that share a block the later one loses it: the documents are aligned by patience diff on their line hashes,
and aligned blocks of at least ``BLOCK_WORDS`` words are deleted.  The result is that of aligning all pairs of documents, but
pairs grow with the documents, not with their square.  Every line of a block lies in a run, the fewest neighbouring lines from
some line on, or up to it, that have ``BLOCK_WORDS`` words.  Each document is aligned

1. with the first holder of each of its runs;
2. where a run is still there (it is repeated, or its holder has another order), with the first holder of each shape that the
   run has in a document: the places of its lines, all other lines being gaps;
3. where it is still there, with all holders that share a further line with it, and, if a shape alone would align, with all of that
   shape.  No other document can align the run: one that shares nothing else is, to this document, its shape.  Holders that are alike but for lines
   that no other holder has align alike, so the first of each such form stands for the rest: pairs grow with documents times forms.

Only line hashes travel to the pairs; texts move once, for the deletion.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.arrays import binary, lists
from sluice.llm.scratch import Scratch, fresh

BLOCK_WORDS = 8
#: Stands for other lines in a run's shape.
GAP = -1


def _rising(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first number, in which the second rises too."""
    tails, at, back = [], [], [0] * len(places)
    for k, (_, j) in enumerate(places):
        t = bisect_left(tails, j)
        back[k] = at[t - 1] if t else -1
        if t == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[t], at[t] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(places[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) by patience diff: common lines at both ends, then lines that are unique on both sides in
    their longest common order, and the same between those.  Zero stands for a blank line."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        once: dict[int, int] = {}
        for k in range(i, n):
            once[a[k]] = -1 if a[k] in once else k
        seen: dict[int, int] = {}
        for k in range(j, m):
            if once.get(b[k], -1) >= 0:
                seen[b[k]] = -1 if b[k] in seen else k
        common = _rising(sorted((once[h], k) for h, k in seen.items() if k >= 0 and h))
        if not common:
            continue
        for p, q in [*common, (n, m)]:
            if i < p and j < q:
                todo.append((i, p, j, q))
            if p < n:
                out.append((p, q))
            i, j = p + 1, q + 1
    return sorted(out)


def common_blocks(a: list[int], b: list[int], size: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """The places in b of aligned blocks (neighbours on both sides) that have ``least`` words or more."""
    out, block = [], []
    for i, j in [*patience(a, b), (-1, -1)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(size[q] for _, q in block) >= least:
                out += [q for _, q in block]
            block = []
        block.append((i, j))
    return out


def minimal_runs(size: list[int], least: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """(start, stop) of the shortest runs of lines that begin or end at some line and have ``least`` words or more."""
    out, stop, start, words, back = set(), 0, 0, 0, 0
    for i, n in enumerate(size):
        while stop < len(size) and words < least:
            words += size[stop]
            stop += 1
        if words >= least and i < stop:
            out.add((i, stop))
        words -= n
        back += n
        while start < i and back - size[start] >= least:
            back -= size[start]
            start += 1
        if back >= least:
            out.add((start, i + 1))
    return sorted(out)


def shape(lines: list[int], run: list[int]) -> list[int]:
    """``lines`` with all but those of ``run``, and blank ones beside them, put together to gaps."""
    own = [x != 0 and x in run for x in lines]
    for places in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):
        step = -1 if places.step > 0 else 1
        for i in places:
            own[i] = own[i] or (lines[i] == 0 and own[i + step])
    out: list[int] = []
    for x, mine in zip(lines, own, strict=True):
        if mine:
            out.append(x)
        elif not out or out[-1] != GAP:
            out.append(GAP)
    return out


def _lines(batches):
    """(id, d1, hashes, sizes): each line's hash without the blanks around it (a blank line's is 0), and its number of words."""
    for batch in batches:
        text = binary(batch.column("text"))
        for row in range(0, len(text), 1000):
            hashes, sizes, at = [], [], [0]
            for t in text.slice(row, 1000):
                for line in t.as_py().split(b"\n"):
                    line = line.strip()
                    hashes.append((xxhash.xxh3_64_intdigest(line) or 1) if line else 0)
                    sizes.append(len(line.split()))
                at.append(len(hashes))
            n = len(at) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(row, n), batch.column("d1").slice(row, n),
                 lists(np.array(hashes, dtype=np.uint64).view(np.int64), np.array(at), pa.int64()), lists(np.array(sizes, dtype=np.int32), np.array(at), pa.int32())],
                names=["id", "d1", "hashes", "sizes"])


def _aligned(least):
    def run(batches):
        for batch in batches:
            ids, d1s, out = [], [], []
            for i, d1, a, b, size in zip(*(batch.column(c).to_pylist() for c in ("b", "d1", "ha", "hb", "size")), strict=True):
                if found := common_blocks(a, b, size, least):
                    ids.append(i)
                    d1s.append(d1)
                    out.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(d1s, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["id", "d1", "gone"])
    return run


def _runs(least):
    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for i, d1, hashes, size in zip(*(batch.column(c).to_pylist() for c in ("id", "d1", "hashes", "sizes")), strict=True):
                whole = np.array(hashes, dtype=np.int64)
                rows += [(i, d1, xxhash.xxh3_64_intdigest(whole[p:q].tobytes()), p, q) for p, q in minimal_runs(size, least)]
            c = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(np.array(c[2], dtype=np.uint64).view(np.int64)), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32())],
                names=["id", "d1", "key", "start", "stop"])
    return run


def _open(batches):
    """Of each run (key, start, stop) that is not all gone the places that are left."""
    for batch in batches:
        ids, d1s, keys, places = [], [], [], []
        for i, d1, runs, gone in zip(*(batch.column(c).to_pylist() for c in ("id", "d1", "runs", "gone")), strict=True):
            lost = set(gone or [])
            for r in runs:
                if left := [k for k in range(r["start"], r["stop"]) if k not in lost]:
                    ids.append(i)
                    d1s.append(d1)
                    keys.append(r["key"])
                    places.append(left)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(d1s, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["id", "d1", "key", "places"])


def _shapes(batches):
    for batch in batches:
        found = [shape(hashes, hashes[p:q]) for hashes, p, q in zip(*(batch.column(c).to_pylist() for c in ("hashes", "start", "stop")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("d1"), batch.column("key"), pa.array(found, pa.list_(pa.int64()))], names=["id", "d1", "key", "shape"])


def _fitting(least):
    """The rows whose shape alone would align some of the places."""
    def run(batches):
        for batch in batches:
            fits = [not set(places).isdisjoint(common_blocks(a, b, size, least))
                    for a, b, size, places in zip(*(batch.column(c).to_pylist() for c in ("shape", "hashes", "sizes", "places")), strict=True)]
            yield batch.select(["id", "key", "shape"]).filter(pa.array(fits, pa.bool_()))
    return run


def _masks(batches):
    """(id, d1, n, gone) to (id, d1, keep): of each line whether it stays."""
    for batch in batches:
        keep = []
        for n, gone in zip(batch.column("n").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            stay = np.ones(n, dtype=bool)
            stay[gone] = False
            keep.append(stay.tolist())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("d1"), pa.array(keep, pa.list_(pa.bool_()))], names=["id", "d1", "keep"])


def line_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = BLOCK_WORDS) -> DataFrame:
    """(id, d1, keep): of each text that loses lines which of them stay; d1 is the text's xxhash64."""
    keep = Scratch(docs.sparkSession, "lines")
    source = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("d1"), F.col(text_col).alias("text"))
    lines = source.mapInArrow(_lines, "id long, d1 long, hashes array<long>, sizes array<int>")
    lines = keep.keep(lines.dropDuplicates(["id", "d1"]))
    runs = keep.keep(lines.mapInArrow(_runs(least), "id long, d1 long, key long, start int, stop int"))
    held = runs.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    mine = keep.keep(runs.join(held, "key").where("id > first"))

    one = lines.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    other = lines.select(F.col("id").alias("b"), "d1", F.col("hashes").alias("hb"), F.col("sizes").alias("size"))

    def aligned(pairs):
        found = pairs.join(one, "a").join(other, "b").select("b", "d1", "ha", "hb", "size").mapInArrow(_aligned(least), "id long, d1 long, gone array<int>")
        return keep.keep(found.groupBy("id", "d1").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))

    def still_there(among, gone):
        listed = among.groupBy("id", "d1").agg(F.collect_list(F.struct("key", "start", "stop")).alias("runs")).join(gone, ["id", "d1"], "left")
        return keep.keep(listed.mapInArrow(_open, "id long, d1 long, key long, places array<int>"))

    def both(a, b):
        return a.unionByName(b).groupBy("id", "d1").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))

    pairs = keep.keep(mine.select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    gone = aligned(pairs)
    left = still_there(mine, gone)
    if not left.isEmpty():
        holders = runs.join(left.select("key").distinct(), "key", "left_semi").dropDuplicates(["id", "d1", "key"])
        shapes = keep.keep(holders.join(lines, ["id", "d1"]).mapInArrow(_shapes, "id long, d1 long, key long, shape array<long>"))
        firsts = keep.keep(shapes.groupBy("key", "shape").agg(F.min("id").alias("a")))
        further = left.join(firsts, "key").where("a < id").select("a", F.col("id").alias("b")).distinct()
        further = keep.keep(further.join(pairs, ["a", "b"], "left_anti"))
        gone = keep.keep(both(gone, aligned(further)))
        pairs = pairs.unionByName(further)
        left = still_there(mine.join(left.select("id", "d1", "key").distinct(), ["id", "d1", "key"], "left_semi"), gone)
        if not left.isEmpty():
            holders = shapes.join(left.select("key").distinct(), "key", "left_semi").select("id", "d1", "key")
            reps = keep.keep(representatives(holders, lines))
            further = keep.keep(_last_pairs(left, lines, shapes, firsts, reps, least).join(pairs, ["a", "b"], "left_anti"))
            gone = both(gone, aligned(further))
    sized = lines.select("id", "d1", F.size("hashes").alias("n")).join(gone, ["id", "d1"])
    return keep.last(sized.mapInArrow(_masks, "id long, d1 long, keep array<boolean>"))


def _forms(batches):
    """(id, d1, form): a digest of each document with all lines but the listed ones put together to gaps."""
    for batch in batches:
        found = [xxhash.xxh3_128_hexdigest(np.array(shape(hashes, set(shared or [])), dtype=np.int64).tobytes())
                 for hashes, shared in zip(*(batch.column(c).to_pylist() for c in ("hashes", "shared")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("d1"), pa.array(found, pa.string())], names=["id", "d1", "form"])


def representatives(holders: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, a): of the holders (id, d1, key) of each run the first of each form.

    A document's form is what is left of it when lines that no other holder has become gaps.  Such lines align with nothing, so documents of one
    form align alike with any other, and the first of them stands for all.
    """
    whole = holders.select("id", "d1").distinct().join(lines.select("id", "d1", "hashes"), ["id", "d1"])
    each = whole.select("id", "d1", F.explode(F.array_distinct("hashes")).alias("y")).where("y != 0")
    common = each.groupBy("y").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("y")
    shared = each.join(common, "y").groupBy("id", "d1").agg(F.collect_list("y").alias("shared"))
    forms = whole.join(shared, ["id", "d1"], "left").mapInArrow(_forms, "id long, d1 long, form string")
    return holders.join(forms, ["id", "d1"]).groupBy("key", "form").agg(F.min("id").alias("a")).select("key", "a").distinct()


def _last_pairs(left: DataFrame, lines: DataFrame, shapes: DataFrame, firsts: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """(a, b): the earlier representatives of each run in ``left`` that share a further line, or whose shape would align it."""
    whole = left.join(lines, ["id", "d1"])
    held = shapes.join(reps.select("key", F.col("a").alias("id")), ["key", "id"], "left_semi").join(lines, ["id", "d1"])
    held = held.select("key", F.col("id").alias("a"), F.explode(F.array_except("hashes", F.array_append("shape", F.lit(0).cast("long")))).alias("y"))
    mine = whole.select("key", F.col("id").alias("b"), F.explode(F.array_distinct("hashes")).alias("y")).distinct()
    sharing = mine.join(held, ["key", "y"]).where("a < b").select("a", "b")
    fitting = whole.join(firsts, "key").where("a < id").select("id", "key", "shape", "hashes", "sizes", "places")
    fitting = fitting.mapInArrow(_fitting(least), "id long, key long, shape array<long>").withColumnRenamed("id", "b").distinct()
    alike = fitting.join(shapes.select("key", "shape", F.col("id").alias("a")).join(reps, ["key", "a"], "left_semi"), ["key", "shape"]).where("a < b").select("a", "b")
    return sharing.unionByName(alike).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the text's duplicate blocks deleted; other columns stay as they are.

    A block goes if it is aligned with a block of a document with a smaller id; blocks are judged on the input.  Null texts stay
    null, rows without id and empty texts stay as they are, and repeated rows under one id are treated alike.  Lines are joined by "\\n" again.
    """
    own, digest, keep = (fresh(c, docs) for c in ("id", "d1", "keep"))
    masks = line_masks(docs, id_col, text_col, least).select(F.col("id").alias(own), F.col("d1").alias(digest), F.col("keep").alias(keep))
    text = F.col(text_col)
    joined = docs.join(masks, (F.col(id_col).cast("long") == F.col(own)) & (F.xxhash64(text) == F.col(digest)), "left")
    stays = F.filter(F.split(text, "\n", -1), lambda line, i: F.get(keep, i))
    return joined.select(*[
        F.when(F.col(keep).isNull(), text).otherwise(F.array_join(stays, "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns])
