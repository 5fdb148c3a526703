"""Secret scans: fixed rules, and a character network over every candidate and its surroundings.

Rules find values behind a keyword, access keys and long hexadecimal numbers.  Their findings label the candidates of the corpus, all runs of
key characters that hold a digit: a candidate in a finding is a secret, any other is not.  The network is trained on all candidates of
some documents, each seen with and without its surroundings and in the other letter case, secrets also in the surroundings of other candidates, so
that it learns what the values look like and not the keyword alone.  The candidates are dealt into blocks by hash; in each epoch every block
teaches a copy of the network, and the copies' weights are averaged.  Scores are calibrated on all candidates of the other documents.  The threshold must recall ``RECALL`` of the findings there without
their surroundings; of the thresholds that do with the fewest false alarms, the middle one is taken.  Candidates outside the rules' findings that reach it are added as ``model`` spans; the rules' own spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.char_cnn import AFTER, BEFORE, VALUE, Network, encode
from sluice.llm.labelled import chance, held_out
from sluice.llm.pu_quality import sigmoid
from sluice.llm.scratch import Scratch

# The rules' patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "model"]

#: A whole run of key characters with a digit; every run is looked at once.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z+/_.=-]*+[0-9][A-Za-z0-9+/_.=-]*+")
SHORTEST = 8
#: Distinct candidates that a block holds, about, when there are more.
BLOCK = 5_000
EPOCHS = 6
#: All candidates of a label together weigh as much as so many when there are more: common ones do not drown the secrets.
SECRETS, OTHERS = 2_000, 3_000
#: Fewer findings than this teach nothing.
FEWEST = 20
RECALL = 0.99

Span = tuple[int, int, int]  # start, place in KINDS, end


def rule_spans(text: str) -> list[Span]:
    """The rules' spans; of one rule they do not overlap."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # Runs of this class are separated by other characters, so asking for the least length at once finds the same ones.
    out += [(m.start(), 2, m.end()) for m in re.finditer(f"{HEX.pattern[:-1]}{{{LEAST['hex']},}}", text)]
    return sorted(out)


def candidates(text: str, spans: list[Span]) -> list[tuple[int, int, bool]]:
    """(start, end, whether a rule's span overlaps it) of each candidate."""
    out, k, reach, ordered = [], 0, 0, sorted(spans)
    for m in CANDIDATE.finditer(text):
        start, end = m.start(), m.end()
        while end > start and text[end - 1] == ".":
            end -= 1
        if end - start < SHORTEST:
            continue
        while k < len(ordered) and ordered[k][0] < end:
            reach = max(reach, ordered[k][2])
            k += 1
        out.append((start, end, reach > start))
    return out


def views(text: str, start: int, end: int) -> list[tuple[str, str, str]]:
    """(before, value, after) for the network; a candidate longer than its window gives several, the last one flush with the end."""
    starts = [*range(start, max(start, end - VALUE), VALUE), max(start, end - VALUE)]
    return [(text[max(0, start - BEFORE):start], text[s:min(end, s + VALUE)], text[end:end + AFTER]) for s in starts]


def _findings(batches):
    """(label, before, value, after, half) of every view of every candidate."""
    names = ["half", "label", "before", "value", "after"]
    for batch in batches:
        rows: list[tuple] = []
        for half, text in zip(batch.column("half").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            for start, end, found in candidates(text, rule_spans(text)):
                rows += [(half, int(found), *v) for v in views(text, start, end)]
        c = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.bool_()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.string()) for x in c[2:])], names=names)


@dataclass
class Detector:
    network: Network
    slope: float
    constant: float
    threshold: float

    def scores(self, seen: list[tuple[str, str, str]]) -> np.ndarray:
        return sigmoid(self.network.logits(encode(seen)) * self.slope + self.constant) if seen else np.zeros(0)


def _middle(highest: float, below: float | None) -> float:
    return float(highest) if below is None else float((highest + below) / 2)


def constrained_threshold(logit: np.ndarray, y: np.ndarray, recall: float = RECALL) -> float:
    """A logit at or above which ``recall`` of the ones lie, and as few zeros as that allows; the middle of all such thresholds."""
    ones, zeros = np.sort(logit[y == 1]), np.sort(logit[y == 0])
    highest = ones[int(np.floor((1 - recall) * len(ones)))]
    below = zeros[zeros < highest]
    return _middle(highest, below[-1] if len(below) else None)


def value_at(rows: DataFrame, place: int, few: int = 10_000, bins: int = 1000) -> float:
    """The value of column ``x`` at ``place`` (from 0) in ascending order.  The range that holds it is cut until ``few`` values are left."""
    def ends(of):
        return of.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n"))

    found, inside = ends(rows.groupBy()).first(), rows
    while found["n"] > few and found["low"] < found["high"]:
        low, width = found["low"], (found["high"] - found["low"]) / bins
        part = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1))
        for found in sorted(ends(inside.groupBy(part.alias("part"))).collect(), key=lambda r: r["part"]):  # no more than ``bins`` rows
            if place < found["n"]:
                break
            place -= found["n"]
        inside = rows.where(F.col("x").between(found["low"], found["high"]))
    return found["low"] if found["low"] == found["high"] else sorted(r["x"] for r in inside.select("x").collect())[place]


def table_threshold(rows: DataFrame, recall: float = RECALL) -> float:
    """``constrained_threshold`` of a table (label, x)."""
    ones = rows.where("label = 1")
    highest = value_at(ones, int(np.floor((1 - recall) * ones.count())))
    return _middle(highest, rows.where((F.col("label") == 0) & (F.col("x") < highest)).agg(F.max("x")).first()[0])


def calibration(rows: DataFrame, ridge: float = 1e-3, steps: int = 40) -> tuple[float, float]:
    """Slope and constant of a logistic model of ``label`` by ``x``: Newton's method, its sums taken over the whole table."""
    w, penalty = np.zeros(2), np.array([ridge, 1e-6])
    x = F.col("x")
    for _ in range(steps):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x * float(w[0]) + float(w[1])))))
        part = rows.select("x", (F.col("label") - p).alias("off"), (p * (1 - p) + 1e-9).alias("curve"))
        total = [F.sum(c) for c in (x * F.col("off"), F.col("off"), x * x * F.col("curve"), x * F.col("curve"), F.col("curve"))]
        a, b, aa, ab, bb = part.agg(*(c.alias(f"s{k}") for k, c in enumerate(total))).first()
        step = np.linalg.solve(np.array([[aa, ab], [ab, bb]]) + np.diag(penalty), np.array([a, b]) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def _lessons(rows: list[tuple], weights: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, labels and weights of all that (label, before, value, after) rows teach."""
    seen, y = [r[1:] for r in rows], np.array([r[0] for r in rows], dtype=np.float64)
    other = [tuple(part.swapcase() for part in row) for row in seen]
    secret, rest = ([r[1:] for r in rows if r[0] == k] for k in (1, 0))
    moved = [(rest[k % len(rest)][0], r[1], rest[k % len(rest)][2]) for k, r in enumerate(secret)] if rest else []
    x = np.concatenate([encode(seen), encode(seen, blank_context=True), encode(other), encode(other, blank_context=True), encode(moved)])
    y = np.append(np.tile(y, 4), np.ones(len(moved)))
    return x, y, np.where(y == 1, weights[1], weights[0])


def taught(dealt: DataFrame, state: np.ndarray, epoch: int, weights: dict[int, float]) -> DataFrame:
    """(block, n, state) of each block of ``dealt`` (block, label, before, value, after): what ``state`` is after one epoch over its ``n`` rows."""
    def run(key, block):
        rows = sorted(zip(*(block.column(c).to_pylist() for c in ("label", "before", "value", "after")), strict=True))
        network, (first, second) = Network.from_vector(state)
        network.learn(epoch, *_lessons(rows, weights), first, second)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(rows)], pa.int64()),
                         "state": pa.array([network.vector(first, second)], pa.list_(pa.float64()))})
    return dealt.groupBy("block").applyInArrow(run, "block long, n long, state array<double>")


def averaged(states: DataFrame) -> np.ndarray:
    """The mean of all blocks' states, summed in the order of the blocks."""
    each = states.select("block", F.posexplode("state").alias("place", "w")).groupBy("place").agg(F.array_sort(F.collect_list(F.struct("block", "w"))).alias("all"))
    rows = each.select("place", F.expr("aggregate(all, 0D, (s, r) -> s + r.w) / size(all)").alias("w")).collect()  # one row a weight
    return np.array([r["w"] for r in sorted(rows, key=lambda r: r["place"])])


def _logits(network: Network):
    """(label, x) of each candidate's view, with and without its surroundings."""
    def run(batches):
        for batch in batches:
            seen = list(zip(*(batch.column(c).to_pylist() for c in ("before", "value", "after")), strict=True))
            for name, blank in (("seen", False), ("alone", True)):
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([name] * len(seen), pa.string()), pa.array(network.logits(encode(seen, blank)))], names=["label", "view", "x"])
    return run


def fit_detector(docs: DataFrame, seed: int = 17) -> Detector | None:
    """The network, its calibration and its threshold from all findings of the rules in ``docs`` (doc_id, text); None if there are too few."""
    source = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    source = source.select((chance(F.col("doc_id"), seed) < 0.6).alias("half"), "text")
    keep = Scratch(docs.sparkSession, "secrets")
    found = keep.keep(source.mapInArrow(_findings, "half boolean, label int, before string, value string, after string").distinct())
    count = {(r["half"], r["label"]): r["count"] for r in found.groupBy("half", "label").count().collect()}
    if min(count.get((h, y), 0) for h in (True, False) for y in (0, 1)) < FEWEST:
        return None
    n = {label: count[True, label] for label in (0, 1)}
    share = {label: min(n[label], most) / n[label] for label, most in ((0, OTHERS), (1, SECRETS))}
    mean = sum(share[label] * n[label] for label in n) / sum(n.values())
    weights = {label: share[label] / mean for label in n}
    blocks = -(-sum(n.values()) // BLOCK)
    block = F.pmod(F.xxhash64("before", "value", "after", F.lit(seed + 1)), F.lit(blocks))
    # The number keeps small blocks in tasks of their own.
    dealt = keep.keep(found.where("half").select(block.alias("block"), "label", "before", "value", "after")).repartition(blocks, "block")
    network = Network()
    state = network.vector(*network.moments())
    for epoch in range(EPOCHS):
        state = averaged(taught(dealt, state, epoch, weights))
    network, _ = Network.from_vector(state)
    judged = keep.keep(found.where("NOT half").select("label", "before", "value", "after").mapInArrow(_logits(network), "label int, view string, x double"))
    slope, constant = calibration(judged)
    threshold = table_threshold(judged.where("view = 'alone'").select("label", (F.col("x") * slope + constant).alias("x")))
    return Detector(network, slope, constant, float(sigmoid(np.array([threshold]))[0]))


def spans_of(text: str, detector: Detector | None) -> tuple[list[Span], list[Span]]:
    """The rules' spans, and those with the model's."""
    return _all_spans([text], detector)[0]


def _all_spans(texts: list[str], detector: Detector | None) -> list[tuple[list[Span], list[Span]]]:
    base = [rule_spans(t) for t in texts]
    whole = [list(b) for b in base]
    if detector is not None:
        of, seen = [], []
        for k, text in enumerate(texts):
            for start, end, found in candidates(text, base[k]):
                if not found:
                    new = views(text, start, end)
                    seen += new
                    of += [(k, start, end)] * len(new)
        for (k, start, end), score in zip(of, detector.scores(seen), strict=True):
            if score >= detector.threshold and (start, 3, end) not in whole[k][-1:]:
                whole[k].append((start, 3, end))
    return [(b, sorted(w)) for b, w in zip(base, whole, strict=True)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(detector: Detector | None):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = _all_spans([t or "" for t in part.column("text").to_pylist()], detector)
                count = [[sum(kind == k for _, kind, _ in w) for _, w in found] for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in count), pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], pa.string()),
                     pa.array([written(w) for _, w in found], pa.string())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"])
    return run


def scan_secrets(docs: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans) of each row; the network learns from ``corpus`` (else ``docs``).

    A span is kind:start:end in code points, end exclusive; spans are in order of start, then kind.  A null or empty text has none.  Rows without id
    are scanned and never learned from, and of the others those held out (crc32 of the id mod 4 is 2) neither.  Repeated
    rows are scanned alike; equal candidates in equal surroundings teach once.  With too few findings to learn from the rules stand alone.
    """
    def plain(df):
        return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    detector = fit_detector(plain(docs if corpus is None else corpus))
    return plain(docs).mapInArrow(_scan(detector), "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")
