"""Whitening against numpy and exact integers, the FM-index and phrase mining against counting, both on awkward rows."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import fm_index, phrases, queries
from sluice.llm.fm_index import BidirectionalIndex
from sluice.llm.phrases import collocations, frequent_phrases
from sluice.llm.whitening import LIMIT, SHIFT, cross_products, integers, whiten
from tests.conftest import SF001, SF01
from tests.llm.test_queries import _awkward


@pytest.mark.parametrize("low,high,rows,dims", [(0, 1, 5, 3), (-40, 90, 200, 7), (-10**6, 10**6, 65, 4), (-LIMIT, LIMIT, 33, 3), (7, 8, 10, 2)])
def test_cross_products_are_exact(low, high, rows, dims):
    x = np.random.default_rng(1).integers(low, high, (rows, dims)) + SHIFT
    s, p = cross_products(x)
    whole = x.astype(object)
    assert s == whole.sum(axis=0).tolist()
    assert all(p[i][j] == (whole[:, i] * whole[:, j]).sum() for i in range(dims) for j in range(i, dims))


def test_whitening_against_numpy(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").where("embedding IS NOT NULL").collect())
    got: dict = {}
    for r in queries.QUERIES["op12_embedding_whitening"](spark, SF01).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64) + SHIFT
    n, s = len(x), x.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    white = (x - s / n) @ u[:, :32] / np.sqrt(e[:32])
    mine = np.array([[got[i][k]["whitened"] for k in range(1, 33)] for i, _ in rows])
    sign = np.sign((white * mine).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-8
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(32)).max() <= got[rows[0][0]][1]["identity_error"] + 1e-12 < 1e-9
    for k, (i, _) in enumerate(rows):
        assert len(got[i]) == 32 and got[i][1]["n"] == n and got[i][1]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], s, strict=True))
        assert all(abs(got[i][c + 1]["explained"] - e[c] / e.sum()) < 1e-9 for c in range(32))


def test_whitening_on_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.5]), (2, [2.0, 1.0, 0.5]), (3, None), (4, [0.0, 0.0, 0.5]), (5, [1.0, nan, 0.0]), (6, [inf, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, []),
            (9, [-1.5, 1.0, 0.5]), (9, [-1.5, 1.0, 0.5]), (None, [1.0, 0.25, 0.5]), (10, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("vector", F.lit(1)).withColumn("component", F.lit(1))
    got = whiten(frame).collect()
    assert collections.Counter(r["vec_id"] for r in got) == {1: 3, 2: 3, 4: 3, 9: 6, None: 3} and {r["n"] for r in got} == {6}
    assert all((r["whitened"] is None) == (r["component"] == 3) == (r["explained"] == 0) for r in got) and got[0]["identity_error"] < 1e-9
    assert whiten(frame.limit(0)).collect() == [] and whiten(frame.where("vec_id = 8")).collect() == []
    one = whiten(frame.where("vec_id = 1")).collect()
    assert [(r["whitened"], r["deviation"], r["identity_error"]) for r in one] == [(None, 0, 0.0)] * 3
    far = whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(far) == 4 and integers(np.array([1e300]))[0] == LIMIT + SHIFT


def test_index_enumerates_every_phrase():
    rng = np.random.default_rng(2)
    for alphabet, n in [(2, 400), (5, 3000), (700, 2000), (1, 3)]:
        text = rng.integers(0, alphabet + 1, n)
        text[0] = text[-1] = 0
        for size, nodes in enumerate(BidirectionalIndex(text, 5).phrases(), 1):
            want = collections.Counter(tuple(text[i:i + size].tolist()) for i in range(n - size + 1) if (text[i:i + size] > 0).all())
            assert dict(zip(map(tuple, nodes.words.tolist()), nodes.count.tolist(), strict=True)) == want and len(nodes) == len(want)


def test_index_extends_in_blocks(monkeypatch):
    monkeypatch.setattr(fm_index, "BLOCK", 7)
    test_index_enumerates_every_phrase()
    assert [len(n) for n in BidirectionalIndex(np.zeros(3, dtype=np.int64), 3).phrases()] == [0, 0, 0]


def test_a_task_adds_up_its_shards_and_hands_on_small_batches(monkeypatch):
    """Seven shards of one task: each phrase leaves it once, with the sum, never more than ``ROWS`` at a time."""
    monkeypatch.setattr(phrases, "ROWS", 10)
    rng = random.Random(4)
    rows = [(rng.choice(["en", "de", "e n"]), " ".join(rng.choice("abcdefg") for _ in range(40))) for _ in range(20)]
    texts = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})
    shards = pa.Table.from_batches(phrases._shards(120)([texts])).combine_chunks()
    batch = shards.append_column("shard", pa.array(range(len(shards)))).to_batches()[0]
    assert batch.num_rows == 7
    want, _ = counted(rows, 1, 4)
    each = [phrases.Shard(batch.slice(k, 1)) for k in range(7)]
    pairs = {p for s in each for p in phrases._pairs(s, np.arange(len(s.word) + 1) > 0).column("pair").to_pylist()}
    got = list(phrases._summed(phrases._sorted(list(pairs)), 4)([batch]))
    found = [((r["lang"], *r["phrase"].split(" ")), r["count"]) for b in got for r in b.to_pylist()]
    assert max(b.num_rows for b in got) == 10 and len(found) == len(dict(found)) and dict(found) == {k: v for k, v in want.items() if len(k) > 2}
    assert list(phrases._summed(phrases._sorted([]), 4)([batch, batch.slice(0, 0)])) == []


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least, longest):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", *w[i:i + k]] += 1
    return {k: v for k, v in f.items() if v >= least}, n


def mined(rows, least, longest, top):
    f, n = counted(rows, least, longest)
    longer: collections.Counter = collections.Counter()
    for (lang, *w), a in f.items():
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if j - i < len(w):
                    longer[lang, *w[i:j]] = max(longer[lang, *w[i:j]], a)
    out = []
    for (lang, *w), a in f.items():
        if len(w) > 1 and longer[lang, *w] < a:
            score, _, le, r = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), le, r))
    ranks: collections.Counter = collections.Counter()
    rows = []
    for lang, score, a, phrase, le, r in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase.decode(), -a, le, r, n[lang], -score))
    return rows


@pytest.mark.parametrize("shard_words,longest,top,few", [(1 << 22, 5, 2000, 10**6), (700, 5, 20, 10**6), (300, 3, 7, 10**6), (50, 2, 2000, 10**6), (2000, 5, 2000, 0)])
def test_phrases_against_counting(spark, shard_words, longest, top, few):
    """``few`` of 0 sends each shard its own frequent words and pairs."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").repartition(3)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, collocations(docs, least=8, longest=longest, top=top, shard_words=shard_words, words=few, pairs=few).collect()))
    assert got == sorted(mined(rows, 8, longest, top)) and len(got) > 20


def test_phrases_on_hard_texts(spark):
    rng = random.Random(3)
    rows = [(None, "a a a a a a a"), ("en", ""), ("en", None), ("und", "A b a B"), ("x", "\t \n"), ("en", "one two three. one two three! one two three")] * 3
    rows += [("en", " ".join(rng.choice(["red", "Red", "blue", "\x00", "\x1f", "ß", "É"]) + rng.choice(["", ".", "\n", "\t"]) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    docs = spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)], "doc_id long, lang string, text string, word string, phrase int")
    for shard_words in (5, 1000):
        assert sorted(map(tuple, collocations(docs, least=3, shard_words=shard_words).collect())) == sorted(mined(rows, 3, 5, 2000))
    found, totals = frequent_phrases(docs, least=3)
    f, n = counted(rows, 3, 5)
    assert {(r["lang"], *r["phrase"].split(" ")): r["f"] for r in found.collect()} == f and {r["lang"]: r["n"] for r in totals.collect()} == {k: v for k, v in n.items() if v}
    awkward = _awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert [r["phrase"] for r in collocations(awkward, least=2).collect() if r["rank"] == 1] and collocations(_awkward(spark, True).withColumn("lang", F.lit("en"))).collect() == []
