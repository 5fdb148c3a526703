"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.  Toxic documents are mostly ordinary language, so
the toxic one is trained on what sets them apart: their words that are over-represented against ordinary documents, in
their order, a document a sample.  Every window of ``WINDOW`` words of a whole text is compressed under the ordinary dictionary
and under the ordinary and toxic ones together; ordinary language costs the same under both, and a window that costs less
under the second is like toxic text.  How many bytes a document's windows save is turned into a score by a logistic
model, fitted on labelled rows that the dictionaries were not trained on.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.arrays import binary, lists
from sluice.llm.labelled import chance, held_out, sample, texts_of, trained
from sluice.llm.pu_quality import logistic, sigmoid

WINDOW = 2
#: Labelled rows sampled: toxic and ordinary texts for the dictionaries, and rows that calibrate.
TOXIC, ORDINARY, CALIBRATION = 3_000, 4_000, 8_000
#: Windows of an ordinary text that train its dictionary.
EXAMPLES = 20
TOXIC_BYTES, ORDINARY_BYTES = 2048, 2048
#: A word is over-represented if this share of the toxic texts holds it, exp(LIFT) times as often as ordinary ones.
SHARE, LIFT, VOCABULARY = 0.015, 2.5, 2000
#: Both dictionaries end with it and every window begins with it: no window is too short to compress.
ANCHOR = bytes(range(160, 224))


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    parts = text.lower().split()  # bytes: A-Z only
    return [ANCHOR + b" " + b" ".join(parts[i:i + size]) + b" " for i in range(0, len(parts), size)]


class Compressor:
    """The compressed length of windows under one dictionary."""

    def __init__(self, content: bytes):
        form = zstandard.ZstdCompressionParameters(
            window_log=14, hash_log=12, chain_log=12, search_log=3, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        known = zstandard.ZstdCompressionDict(content + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=form)
        self._compress = zstandard.ZstdCompressor(compression_params=form, dict_data=known).compress

    def lengths(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter((len(self._compress(w)) for w in found), dtype=np.float64, count=len(found))


def trained_dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; too few of them are the content themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def savings(text: bytes, ordinary: Compressor, toxic: Compressor) -> list[float]:
    """What a text's windows save under the toxic dictionary: the three most, the mean, the sum, and how many save a little or more."""
    found = windows(text)
    if not found:
        return [0.0] * 8
    s = ordinary.lengths(found) - toxic.lengths(found)
    top = np.sort(s)[::-1][:3]
    gain = np.maximum(s, 0).sum()
    return [float(top[0]), float(top[min(1, len(top) - 1)]), float(top[-1]), gain / len(s), np.log1p(gain), np.log1p(len(s)),
            float((s >= 2).mean()), np.log1p((s >= 3).sum())]


def _features(ordinary: bytes, toxic: bytes):
    def run(batches):
        plain, both = Compressor(ordinary), Compressor(ordinary + toxic)
        for batch in batches:
            rows = [savings(t.as_py(), plain, both) for t in binary(batch.column("text"))]
            f = np.array(rows).reshape(len(rows), 8)
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists(f.reshape(-1), np.arange(len(f) + 1) * 8, pa.float64())], names=["label", "f"])
    return run


def _scored(ordinary: bytes, toxic: bytes, mean, spread, weights):
    def run(batches):
        plain, both = Compressor(ordinary), Compressor(ordinary + toxic)
        for batch in batches:
            rows = [savings(t.as_py(), plain, both) for t in binary(batch.column("text"))]
            f = (np.array(rows).reshape(len(rows), 8) - mean) / spread
            # Row by row: a matrix product may round a row by its place in the batch.
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid((f * weights[:-1]).sum(axis=1) + weights[-1]))], names=["doc_id", "score"])
    return run


def _examples(batches):
    for batch in batches:
        out = []
        for t in binary(batch.column("text")):
            found = windows(t.as_py(), 4)
            out += [w[len(ANCHOR):] for w in found[::max(1, len(found) // EXAMPLES)]]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["window"])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "toxic", seed: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text).

    A null text scores as an empty one, which saves nothing.  Without toxic or without ordinary rows to learn from, every score is 0.
    Rows without id are scored and never learned from; repeated rows score alike.  Equal whole texts of one label train the
    dictionaries once; texts that only begin or end alike all do.  Of the rows under one id the least text alone is learned from.  Scores do not depend on the order of rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = trained(labels, label).withColumn("half", chance(F.col("doc_id"), seed) < 0.5)
    chosen = sample(known.where("half AND label = 1"), TOXIC, seed + 1).unionByName(
        sample(known.where("half AND label = 0"), ORDINARY, seed + 2)).select("doc_id", "label")
    # Bounded by the sample sizes.  Equal whole texts of one label count once.
    texts = texts_of(docs, chosen, "label").select("text", "label").distinct()
    split = F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    texts = texts.select("text", "label", split.alias("words")).cache()
    total = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"))
    if len(total) < 2:
        return out.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    in_toxic, in_plain = (F.sum((F.col("label") == k).cast("int")) for k in (1, 0))
    lift = F.log((F.col("a") + 0.5) / (total[1] + 1) / ((F.col("b") + 0.5) / (total[0] + 1)))
    per_word = texts.select("label", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(in_toxic.alias("a"), in_plain.alias("b"))
    apart = per_word.where((F.col("a") >= max(4, SHARE * total[1])) & (lift > LIFT)).orderBy((F.col("a") * lift).desc(), "word").limit(VOCABULARY)
    apart = [r["word"] for r in apart.select("word").collect()]
    marked = texts.where("label = 1").select(F.array_join(F.filter("words", lambda w: w.isin(apart) if apart else F.lit(False)), " ").alias("s"))
    toxic_samples = sorted(f" {r['s']} ".encode() for r in marked.where("s != ''").toLocalIterator())
    plain_samples = sorted(bytes(r["window"]) for r in texts.where("label = 0").select("text").mapInArrow(_examples, "window binary").toLocalIterator())
    random.Random(seed).shuffle(toxic_samples)
    random.Random(seed).shuffle(plain_samples)
    toxic, plain = trained_dictionary(toxic_samples, TOXIC_BYTES), trained_dictionary(plain_samples, ORDINARY_BYTES)
    texts.unpersist()

    rest = sample(known.where("NOT half"), CALIBRATION, seed + 3).select("doc_id", "label")
    rows = texts_of(docs, rest, "label").select("text", "label").mapInArrow(_features(plain, toxic), "label int, f array<double>")
    rows = sorted((r["label"], r["f"]) for r in rows.toLocalIterator())  # sums in one order, whatever the tasks' order
    if len({y for y, _ in rows}) < 2:
        return out.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    y, x = np.array([y for y, _ in rows], dtype=float), np.array([f for _, f in rows])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = logistic((x - mean) / spread, y, ridge=0.1)
    scored = docs.mapInArrow(_scored(plain, toxic, mean, spread, weights), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
