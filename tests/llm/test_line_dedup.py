"""Line dedup against the alignment of all pairs of documents that share a line."""

import numpy as np

from sluice.llm import line_dedup as module
from sluice.llm.line_dedup import common_blocks, line_dedup, minimal_runs
from tests.conftest import SF01


def _all_pairs(texts):
    lines = {i: [x.strip(" \t\n\r\x0b\f") for x in t.split("\n")] for i, t in texts.items()}
    code: dict = {}
    hashes = {i: [code.setdefault(x, len(code) + 1) if x else 0 for x in ls] for i, ls in lines.items()}
    held: dict = {}
    for i in sorted(hashes):
        for x in set(hashes[i]) - {0}:
            held.setdefault(x, []).append(i)
    gone: dict = {}
    for a, b in {(a, b) for h in held.values() for a in h for b in h if a < b}:
        gone.setdefault(b, set()).update(common_blocks(hashes[a], hashes[b], [len(x.split()) for x in lines[b]]))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in texts.items()}


def _check(spark, texts):
    got = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == _all_pairs(texts)
    return got


def test_runs_begin_or_end_at_each_line():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size = rng.integers(0, 10, rng.integers(0, 9)).tolist()
        want = set()
        for i in range(len(size)):
            want |= {(i, min(found))} if (found := [q for q in range(i + 1, len(size) + 1) if sum(size[i:q]) >= 8]) else set()
            want |= {(max(found), i + 1)} if (found := [p for p in range(i + 1) if sum(size[p:i + 1]) >= 8]) else set()
        assert minimal_runs(size) == sorted(want)


def test_block_of_lines_with_other_first_holders(spark):
    one, two = "a line of four", "another one of four"
    for holders in (5, 6, 7, 40):
        got = _check(spark, {1: f"{one}\nx", 2: f"y\n{two}"} | {i: f"head {i}\n{one}\n{two}\ntail {i}" for i in range(3, 3 + holders)})
        assert [got[i] for i in range(4, 3 + holders)] == [f"head {i}\ntail {i}" for i in range(4, 3 + holders)]


def test_lines_that_the_first_holder_does_not_align(spark):
    rng = np.random.default_rng(8)
    full = [f"line {k} has eight words or more in all" for k in range(6)]
    short = ["one two three", "four five six seven", "eight", ""]
    texts = {}
    for i in range(400):
        lines = [full[k] for k in rng.integers(0, 6, rng.integers(0, 4))] + [short[k] for k in rng.integers(0, 4, rng.integers(0, 4))] + [f"own {i}"] * int(rng.integers(0, 3))
        texts[i] = "\n".join(lines[k] for k in rng.permutation(len(lines)))
    _check(spark, texts)


def test_all_pairs_of_the_documents(spark):
    _check(spark, {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()})


def test_pairs_grow_with_the_documents(spark):
    """Documents that share a header and hold one long line twice: the last step pairs each with the first of its form."""
    counts = []
    for n in (100, 200, 400):
        rng = np.random.default_rng(n)
        long = "this line of eight words is repeated inside"
        texts = {i: "\n".join(["header", f"own {i}", long, *[f"x{i} {k}" for k in range(int(rng.integers(1, 4)))], long, f"end {i}"]) for i in range(n)}
        last, real = [], module._last_pairs

        def counted(*args, real=real, last=last):
            found = real(*args)
            last.append(found.count())
            return found
        module._last_pairs = counted
        try:
            _check(spark, texts)
        finally:
            module._last_pairs = real
        counts.append(sum(last))
    assert counts[2] <= 2.2 * counts[1] <= 4.84 * counts[0] and counts[2] <= 5 * 400
