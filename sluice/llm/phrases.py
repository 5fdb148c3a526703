"""Phrase collocation mining over FM-indexes.

Documents become word ids in shards of about ``SHARD_WORDS`` words, each with its own vocabulary; pieces of text are kept apart by breaks.
Per shard a bidirectional FM-index enumerates the phrases of up to ``LONGEST`` words with their counts, and
counts are summed across shards by the phrase's words, so sums are exact.  A phrase can only be frequent if all its parts are, so shards are
indexed twice: first over the words that are frequent in the whole table, for pairs, of which only a hash and a count leave the shard;
then over the stretches whose neighbouring words all may be frequent pairs, for all phrases.  What does not take part is never emitted, and a
pair that only shares a hash with a frequent one falls to its exact count.

Frequent words and pairs are handed to the tasks while they are few (``WORDS``, ``PAIRS``: a bound, checked by counting); beyond that each
shard is sent those that it has.

A phrase inside a longer one that is as frequent is dropped.  The phrases that an index reaches by one more word to the left or right are
enough to tell: whatever holds a phrase any longer way is no more frequent than the step between.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.arrays import chunks, fold, mix, signed
from sluice.llm.fm_index import BidirectionalIndex
from sluice.llm.scratch import Scratch

LEAST, LONGEST, TOP = 100, 5, 2000
SHARD_WORDS = 1 << 19
#: Shards (some 3 MB each) that a task is handed at once: for pairs, which shards hardly share, and for phrases, whose counts are added up.
PAIRS_AT_ONCE, AT_ONCE = 4, 8
#: Phrases that leave a task in one Arrow batch.
ROWS = 1 << 14
#: Frequent words and pairs handed to every task (some 40 and 64 MB).
WORDS, PAIRS = 2_000_000, 8_000_000
#: Parts that each language's phrases are ranked in before the last ranking.
PARTS = 64

_KIND = np.zeros(256, dtype=np.uint8)  # 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2

SHARD = "lang array<string>, word array<string>, count array<long>, ids binary"
COUNTED = "lang string, phrase string, size int, count long"
HASHED = "shard long, pair long, count long"


def packed(ids: np.ndarray) -> bytes:
    """Ids below 2^32 byte by byte, all lowest bytes first, compressed: a third of their plain size."""
    return zstandard.ZstdCompressor(level=3).compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def split_words(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a chunk in lower case, each one's text, and whether it begins a piece."""
    data = fold(data)
    kind = _KIND[data]
    inside = kind == 0
    first = np.zeros(len(data) + 1, dtype=bool)
    first[starts] = True
    before = np.ones(len(data), dtype=bool)
    before[1:] = ~inside[:-1]
    after = np.ones(len(data), dtype=bool)
    after[:-1] = ~inside[1:]
    begin = np.flatnonzero(inside & (before | first[:-1]))
    end = np.flatnonzero(inside & (after | first[1:])) + 1
    text = np.searchsorted(starts, begin, side="right") - 1
    marks = np.cumsum(kind == 2)[begin] if len(begin) else begin
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (marks[1:] != marks[:-1])
    offsets = np.concatenate(([0], np.cumsum(end - begin)))
    found = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside]))
    return found, text, new


def _shards(size: int):
    """Texts to shards: the language, word and count of each id from 1, and the ids in order with 0 between pieces."""
    def shard(found: list[pa.Array], lang: list[np.ndarray], new: list[np.ndarray], names: list[str]):
        coded = pa.chunked_array(found).combine_chunks().dictionary_encode()
        word, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        pair, ids, count = np.unique(np.concatenate(lang) * len(vocabulary) + word, return_inverse=True, return_counts=True)
        starts = np.concatenate(new)
        text = np.zeros(len(ids) + int(starts.sum()) + 1, dtype=np.int32)
        text[np.arange(len(ids)) + np.cumsum(starts)] = ids + 1
        whole = np.array([0, len(pair)])
        cells = [pa.array(np.array(names, dtype=object)[pair // len(vocabulary)], pa.string()), vocabulary.take(pa.array(pair % len(vocabulary))).cast(pa.string()),
                 pa.array(count, pa.int64())]
        return pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(pa.array(whole, pa.int32()), c) for c in cells),
                                           pa.array([packed(text)], pa.binary())], names=["lang", "word", "count", "ids"])

    def run(batches):
        found, lang, new, words, names = [], [], [], 0, {}
        for batch in batches:
            spoken = batch.column("lang").to_pylist()
            for row, data, starts in chunks(batch.column("text")):
                w, text, begins = split_words(data, starts)
                code = np.array([names.setdefault(x, len(names)) for x in spoken[row:row + len(starts) - 1]], dtype=np.int64)[text]
                at, heads = 0, np.append(np.flatnonzero(begins), len(w))
                while at < len(w):  # cut at the last piece that fits; a longer piece stays whole
                    fit = heads[np.searchsorted(heads, at + size - words, side="right") - 1]
                    end = fit if fit > at else (at if words else heads[np.searchsorted(heads, at, side="right")])
                    if end > at:
                        found.append(w.slice(at, end - at))
                        lang.append(code[at:end])
                        new.append(begins[at:end])
                        words += end - at
                    if end < len(w) or words >= size:
                        yield shard(found, lang, new, list(names))
                        found, lang, new, words = [], [], [], 0
                    at = end
        if words:
            yield shard(found, lang, new, list(names))
    return run


def joined(lang: pa.Array, word: pa.Array) -> pa.Array:
    """Language and word as one text; words hold no blank."""
    return pc.binary_join_element_wise(lang.cast(pa.large_string()), word.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))


class Shard:
    """One row of the table of shards."""

    def __init__(self, row: pa.Table | pa.RecordBatch):
        def cells(name):
            column = row.column(name)
            return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
        self.lang, self.word = cells("lang"), cells("word")
        self.text = unpacked(row.column("ids")[0].as_py())
        self.shard = row.column("shard")[0].as_py()

    def hashes(self) -> np.ndarray:
        """A hash of each id's language and word; of a break 0."""
        found = [xxhash.xxh3_64_intdigest(f"{a} {w}") for a, w in zip(self.lang.to_pylist(), self.word.to_pylist(), strict=True)]
        return np.array([0, *found], dtype=np.uint64)

    def frequent(self, lang: pa.Array, word: pa.Array) -> np.ndarray:
        """Of each id whether its language and word are listed; breaks are not."""
        return np.append(False, pc.is_in(joined(self.lang, self.word), value_set=joined(lang, word)).to_numpy(zero_copy_only=False))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def _pairs(shard: Shard, frequent: np.ndarray) -> pa.RecordBatch:
    """(shard, pair, count) of each pair of frequent words."""
    text = np.where(frequent[shard.text], shard.text, 0)
    text = np.append(text[(text > 0) | (np.append(1, text[:-1]) > 0)], 0)  # one break is enough
    _, pairs = BidirectionalIndex(text, 2).phrases()
    h = shard.hashes()
    found = signed(pair_hash(h[pairs.words[:, 0]], h[pairs.words[:, 1]]))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), shard.shard)), pa.array(found), pa.array(pairs.count)], names=["shard", "pair", "count"])


def joined_stretches(text: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """``text`` without the words that are linked to no neighbour (``linked``: to the next one), cut wherever neighbours are not linked."""
    stays = linked.copy()
    stays[1:] |= linked[:-1]
    kept, cut = text[stays], ~linked[stays]
    out = np.zeros(len(kept) + int(cut.sum()) + 1, dtype=np.int64)
    out[1 + np.arange(len(kept)) + np.cumsum(cut) - cut] = kept
    return out


def _found(shard: Shard, pairs: np.ndarray, deepest: int):
    """(words by their place in the shard's vocabulary, counts) of the phrases of each length from 2 to ``deepest`` whose neighbouring words all are listed ``pairs`` (sorted hashes)."""
    text, h = shard.text, shard.hashes()
    linked = np.zeros(len(text), dtype=bool)
    linked[:-1] = (text[:-1] > 0) & (text[1:] > 0)
    at = np.flatnonzero(linked)
    found = signed(pair_hash(h[text[at]], h[text[at + 1]]))
    place = np.minimum(np.searchsorted(pairs, found), max(len(pairs) - 1, 0))
    linked[at] = pairs[place] == found if len(pairs) else False
    for nodes in BidirectionalIndex(joined_stretches(text, linked), deepest).phrases():
        if nodes.words.shape[1] > 1:
            yield (nodes.words - 1).astype(np.int32), nodes.count


def _spelled(ids: np.ndarray, count: np.ndarray, lang: pa.Array, word: pa.Array) -> pa.Table:
    """(lang, phrase, size, count) of phrases given by their words' places in ``word``."""
    phrase = pc.binary_join_element_wise(*(word.take(pa.array(c)) for c in ids.T), " ")
    return pa.table([lang.take(pa.array(ids[:, 0])), phrase, pa.array(np.full(len(ids), ids.shape[1], dtype=np.int32)), pa.array(count)],
                    names=["lang", "phrase", "size", "count"])


def _phrases(shard: Shard, pairs: np.ndarray, deepest: int) -> pa.Table:
    return pa.concat_tables([_spelled(ids, count, shard.lang, shard.word) for ids, count in _found(shard, pairs, deepest)])


def _each_shard(work):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield work(Shard(batch.slice(row, 1)))
    return run


def _added_up(ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ``ids`` and the sum of each one's counts."""
    if not len(ids):
        return ids, count
    order = np.lexsort(ids.T)
    ids, count = ids[order], count[order]
    first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(axis=1)))
    return ids[first], np.add.reduceat(count, first)


def _summed(pairs: np.ndarray, deepest: int):
    """``_phrases`` of the shards that come together, their counts added up before they leave the task.

    Until then a phrase is its words' places in a vocabulary of all these shards; it is spelled in batches of ``ROWS``, so no task ever holds the text of all.
    """
    def run(batches):
        for batch in batches:
            lang, word = batch.column("lang").flatten(), batch.column("word").flatten()
            code = joined(lang, word).dictionary_encode().indices.to_numpy()
            place = np.zeros(len(code), dtype=np.int32)  # of each code's last place: all spell the same
            place[code] = np.arange(len(code), dtype=np.int32)
            place, at, sizes = place[code], 0, {}
            for row in range(batch.num_rows):
                shard = Shard(batch.slice(row, 1))
                own = place[at:at + len(shard.word)]
                at += len(shard.word)
                for ids, count in _found(shard, pairs, deepest):
                    sizes.setdefault(ids.shape[1], []).append((own[ids], count))
            while sizes:
                _, parts = sizes.popitem()
                ids, count = _added_up(*map(np.concatenate, zip(*parts, strict=True)))
                for k in range(0, len(ids), ROWS):
                    yield from _spelled(ids[k:k + ROWS], count[k:k + ROWS], lang, word).combine_chunks().to_batches()
    return run


def _with_own(work):
    """For ``applyInArrow``: a shard and the rows that it was sent."""
    def run(key, shards: pa.Table, own: pa.Table) -> pa.Table:
        out = work(Shard(shards), own)
        return out if isinstance(out, pa.Table) else pa.Table.from_batches([out])
    return run


def _sorted(pairs) -> np.ndarray:
    return np.sort(np.asarray(pairs, dtype=np.int64))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_words: int = SHARD_WORDS,
                     lang_col: str = "lang", text_col: str = "text", words: int = WORDS, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of the phrases of 1 to ``longest`` words that occur ``least`` times or more, and (lang, n), its words.

    A null text has no words; a null language is ``und``.  Rows are counted each by itself, repeated ones too.
    """
    keep = Scratch(docs.sparkSession, "phrases")
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    shards = keep.keep(source.mapInArrow(_shards(shard_words), SHARD).select(F.monotonically_increasing_id().alias("shard"), "*"))
    counted = shards.select("shard", F.explode(F.arrays_zip("lang", "word", "count")).alias("w")).select("shard", "w.lang", F.col("w.word").alias("phrase"), "w.count")
    totals = keep.keep(counted.groupBy("lang").agg(F.sum("count").alias("n")))
    ones = keep.keep(counted.groupBy("lang", "phrase").agg(F.sum("count").alias("f")).where(F.col("f") >= least))
    found = ones.select("lang", "phrase", F.lit(1).alias("size"), "f")
    if longest < 2:
        return found, totals
    # A scan hands a task all shards of its files in one batch: dealt anew, tasks hold a few at a time.
    many = shards.count()

    def spread(at_once):
        return shards.drop("count").repartition(max(1, -(-many // at_once)))

    if ones.count() <= words:
        listed = ones.select("lang", "phrase").toArrow()  # no more than ``words`` rows
        lang, word = (listed.column(c).combine_chunks() for c in ("lang", "phrase"))
        hashed = spread(PAIRS_AT_ONCE).mapInArrow(_each_shard(lambda s: _pairs(s, s.frequent(lang, word))), HASHED)
    else:
        own = keep.keep(counted.join(ones, ["lang", "phrase"], "left_semi").select("shard", "lang", "phrase")).groupBy("shard")
        hashed = shards.drop("count").groupBy("shard").cogroup(own).applyInArrow(_with_own(
            lambda s, own: _pairs(s, s.frequent(own.column("lang").combine_chunks(), own.column("phrase").combine_chunks()))), HASHED)

    def often(rows):
        return rows.groupBy("pair").agg(F.sum("count").alias("f")).where(F.col("f") >= least).select("pair")

    twos = keep.keep(often(hashed))
    if twos.count() <= pairs:
        listed = _sorted(twos.toArrow().column("pair"))  # no more than ``pairs`` numbers
        more = spread(AT_ONCE).mapInArrow(_summed(listed, longest), COUNTED).repartition("lang", "phrase", "size")
    else:
        own = keep.keep(hashed.join(twos, "pair", "left_semi").select("shard", "pair")).groupBy("shard")
        more = shards.drop("count").groupBy("shard").cogroup(own).applyInArrow(_with_own(lambda s, own: _phrases(s, _sorted(own.column("pair")), longest)), COUNTED)
    more = more.groupBy("lang", "phrase", "size").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    return keep.keep(found.unionByName(more)), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shard_words: int = SHARD_WORDS,
                 lang_col: str = "lang", text_col: str = "text", words: int = WORDS, pairs: int = PAIRS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the first ``top`` phrases of 2 to ``longest`` words.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of its lowest-scoring cut, ``n`` the language's words, and score
    floor(1000 * a * n / (l * r)), in decimals.  Phrases inside a longer one that occurs as often are left out.  Ties go to
    the greater count, then to the lesser phrase in byte order.  An empty table, or one without frequent phrases, gives no rows.
    """
    found, totals = frequent_phrases(docs, least, longest, shard_words, lang_col, text_col, words, pairs)

    def part(first, size):
        return F.array_join(F.slice(F.split("phrase", " ", -1), first, size), " ")

    many = found.where("size >= 2")
    inside = many.where("size >= 3").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), "f")
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    open_ones = many.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR longer < f").drop("longer")
    cut = open_ones.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cut = cut.join(found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    a, n, le, r = (F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r"))
    cut = cut.withColumn("above", F.lit(1000).cast("decimal(4,0)") * a * n).withColumn("below", le * r)
    lowest = cut.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = lowest.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
