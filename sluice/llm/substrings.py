"""Substring dedup by level-wise doubling of repeated word windows.

Level one looks at windows of half the wanted length.  Of the half-length windows inside one full window
only the one with the least hash stands for it (its anchor), so two equal full windows have the same anchor, and a
full window whose anchor occurs in one text alone cannot repeat.  Only full windows around a repeated
anchor are extended to twice the length and compared there, by a 128-bit hash.  With ``longest=True`` the
doubling goes on (100, 200, ... words) from the windows found repeated, until no candidates survive.

Equal texts are compared once: the smallest doc_id stands for all.  A hot window costs one row per map task
(partial aggregates of minima); the join that brings a window's smallest document back to its places has two
shuffled sides, which adaptive execution can split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.arrays import BASES, chunks, grams, lists, mix, signed, sliding_min, words
from sluice.llm.scratch import Scratch

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_KEY = "d1 long, d2 long"


def _digest(text: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(text), dtype=np.int64).tolist())


def _anchors(w, half: int, window: int):
    """The anchor of each full window of a chunk, and which windows lie in one document."""
    return sliding_min(mix(grams(w.hash, half)), window - half + 1), w.whole(window)


def _survey(window: int, half: int):
    """(id, d1, d2, n_words, sha, anchors): of each text its digest, word count, the hash of its words and its distinct anchors."""
    def run(batches):
        for batch in batches:
            for row, data, starts in chunks(batch.column("text")):
                w = words(data, starts)
                anchor, whole = _anchors(w, half, window)
                raw, out, parts = data.tobytes(), [], []
                for i in range(len(starts) - 1):
                    text = raw[starts[i]:starts[i + 1]]
                    a, b = w.at[i], w.at[i + 1]
                    parts.append(np.unique(anchor[a:max(a, b - window + 1)]))
                    out.append((*_digest(text), int(b - a), hashlib.sha256(b" ".join(text.split())).hexdigest()))
                at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(row, len(out)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                     pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()),
                     lists(signed(np.concatenate(parts)), at, pa.int64())],
                    names=["id", "d1", "d2", "n_words", "sha", "anchors"])
    return run


def _extend(window: int, half: int):
    """(h1, h2, id, d1, place) of every full window whose anchor is among the row's ``anchors``."""
    def run(batches):
        for batch in batches:
            ids, d1s = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "d1"))
            hits = batch.column("anchors")
            for row, data, starts in chunks(batch.column("text")):
                w = words(data, starts)
                anchor, whole = _anchors(w, half, window)
                found, raw = np.zeros(len(anchor), dtype=bool), data.tobytes()
                for i in range(len(starts) - 1):
                    if _digest(raw[starts[i]:starts[i + 1]])[0] != d1s[row + i]:
                        continue  # another text under the same id
                    span = slice(w.at[i], max(w.at[i], w.at[i + 1] - window + 1))
                    found[span] = np.isin(anchor[span], hits[row + i].values.to_numpy().view(np.uint64))
                at = np.flatnonzero(found & whole)
                doc = np.searchsorted(w.at, at, side="right") - 1
                h1, h2 = grams(w.hash, window)[at], grams(mix(w.hash), window, BASES[1])[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h1)), pa.array(signed(h2)), pa.array(ids[row + doc]), pa.array(d1s[row + doc]), pa.array((at - w.at[doc]).astype(np.int32))],
                    names=["h1", "h2", "id", "d1", "place"])
    return run


def _cut(window: int):
    """(id, d1, n_removed, kept): the text's words without those that a listed window covers."""
    def run(batches):
        for batch in batches:
            for text, places, d1, i in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "d1", "id")), strict=True):
                if _digest(text.encode())[0] != d1:
                    continue
                parts = text.encode().split()
                depth = np.zeros(len(parts) + 1, dtype=np.int64)
                at = np.array(places, dtype=np.int64)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + window, -1)
                gone = np.cumsum(depth)[:-1] > 0
                kept = b" ".join(p for p, g in zip(parts, gone.tolist(), strict=True) if not g).decode()
                yield pa.RecordBatch.from_pydict({"id": pa.array([i], pa.int64()), "d1": pa.array([d1], pa.int64()),
                                                  "n_removed": pa.array([int(gone.sum())], pa.int64()), "kept": pa.array([kept], pa.string())})
    return run


class RepeatedWindows:
    """The repeated windows of a document table.

    ``survey``: one row per document; ``relevant``: the distinct texts that hold a repeated anchor;
    ``places``: (id, h1, h2, place, first): the windows that also start in a document with a smaller id.
    """

    def __init__(self, docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text"):
        if window < 2:
            raise ValueError("window must be at least 2")
        self.window, half = window, (window + 1) // 2
        self.scratch = keep = Scratch(docs.sparkSession, "substrings")
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        self.survey = keep.keep(self.docs.mapInArrow(
            _survey(window, half), f"id long, {_KEY}, n_words long, sha string, anchors array<long>"))
        # Of equal texts the smallest id stands for all; a row without id has no place in the order.
        self.first = keep.keep(self.survey.where("id IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("rep")))
        single = self.survey.where("size(anchors) > 0 AND id IS NOT NULL").join(self.first, ["d1", "d2"]).where("id = rep")
        anchors = keep.keep(single.select("id", "d1", F.explode("anchors").alias("anchor")).distinct())
        # Two texts under one id are no repeat between documents: ids are compared, not texts.
        repeated = anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
        mine = anchors.join(keep.keep(repeated), "anchor").groupBy("id", "d1").agg(F.collect_list("anchor").alias("anchors"))
        self.relevant = keep.keep(self.docs.join(keep.keep(mine), "id"))
        self.windows = keep.keep(self.relevant.mapInArrow(
            _extend(window, half), "h1 long, h2 long, id long, d1 long, place int"))
        again = self.windows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("hi")).where("first < hi").drop("hi")
        self.repeated = keep.keep(again)
        self.places = self.windows.join(self.repeated, ["h1", "h2"]).where("first < id")


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): every text without its repeated windows.

    A word goes if a window of ``window`` words of its document covers it whose word sequence also starts in
    a document with a smaller id; windows are judged on the input.  ``kept`` is null where nothing was
    removed (the text stands); else the kept words joined by one space.  A null text has no words.  A row
    without id neither loses words nor takes them from others; neither do rows that share one id among themselves.
    """
    found = RepeatedWindows(docs, window, id_col, text_col)
    keep = found.scratch
    flagged = keep.keep(found.places.groupBy("id", "d1").agg(F.collect_list("place").alias("places")))
    rows = found.relevant.drop("anchors").join(flagged, ["id", "d1"])
    cut = keep.keep(rows.mapInArrow(_cut(window), "id long, d1 long, n_removed long, kept string").dropDuplicates(["id", "d1"]))
    base = found.survey.drop("anchors").join(found.first, ["d1", "d2"], "left").join(cut, ["id", "d1"], "left")
    copy = F.col("rep").isNotNull() & F.col("id").isNotNull() & (F.col("id") > F.col("rep")) & (F.col("n_words") >= window)
    return base.select(
        F.col("id").alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))


def longest_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, longest): the greatest length ``window * 2**k`` at which a document has a window that an
    earlier document has too; documents without one are left out.  Doubling ends with the first level at
    which no candidates survive.  Of equal texts, only the smallest id is looked at.
    """
    found = RepeatedWindows(docs, window, id_col, text_col)
    keep, length = found.scratch, window
    # A place survives if its window repeats at all; a window of twice the length joins two such places.
    level = keep.keep(found.windows.join(found.repeated, ["h1", "h2"]).select("id", "d1", "place", "h1", "h2", "first"))
    out = level.where("first < id").select("id").distinct().withColumn("longest", F.lit(length).cast("long"))
    while True:
        later = level.select("id", "d1", (F.col("place") - length).alias("place"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
        pair = level.select("id", "d1", "place", "h1", "h2").join(later, ["id", "d1", "place"]).select(
            "id", "d1", "place", F.xxhash64("h1", "h2", "g1", "g2").alias("h1"), F.xxhash64("g2", "h1", "g1", "h2").alias("h2"))
        pair = keep.keep(pair)
        again = pair.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("hi")).where("first < hi").drop("hi")
        level, length = keep.keep(pair.join(again, ["h1", "h2"])), 2 * length
        if level.isEmpty():
            return out.groupBy(F.col("id").alias("doc_id")).agg(F.max("longest").alias("longest"))
        out = out.unionByName(level.where("first < id").select("id").distinct().withColumn("longest", F.lit(length).cast("long")))
