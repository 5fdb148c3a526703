"""URL filter: glob rules as one bit-parallel automaton over the canonical URL (host, then path).

Every rule is a pattern over bytes; all patterns' states are bits of one row of 64-bit words (Shift-And).  For each
byte of the URL the whole row is shifted by one, masked by the byte's table, and joined with the bits of
states that loop on a wildcard.  All URLs of an Arrow batch step together, and all patterns with them.

Patterns: ``*`` any run without "/", ``**`` any run, ``?`` one byte but "/"; everything else stands for itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.arrays import chunks


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, where the path begins with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


class Automaton:
    """Glob patterns packed into multiword masks.  State i of a pattern: its first i symbols are read."""

    def __init__(self, patterns: Sequence[str]):
        symbols = [self._symbols(p) for p in patterns]
        bits = sum(len(lits) + 1 for lits, _ in symbols)
        self.words = (bits + 63) // 64
        step, loop = np.zeros((256, bits), dtype=bool), np.zeros((256, bits), dtype=bool)
        start, self.accept, at = np.zeros(bits, dtype=bool), [], 0
        slash = np.arange(256) == 47
        for lits, stars in symbols:
            start[at] = True
            for i, lit in enumerate(lits):
                step[:, at + i + 1] = ~slash if lit is None else np.arange(256) == lit
            for i, star in stars.items():
                loop[:, at + i] = True if star == "**" else ~slash
            at += len(lits) + 1
            self.accept.append(at - 1)
        self.step, self.loop, self.start = self._pack(step), self._pack(loop), self._pack(start[None])[0]

    def _symbols(self, pattern: str):
        raw, lits, stars, i = pattern.encode(), [], {}, 0
        while i < len(raw):
            if raw[i:i + 1] == b"*":
                run = 2 if raw[i:i + 2] == b"**" else 1
                stars[len(lits)] = "**" if run == 2 or stars.get(len(lits)) == "**" else "*"
                i += run
            else:
                lits.append(None if raw[i:i + 1] == b"?" else raw[i])
                i += 1
        return lits, stars

    def _pack(self, flags: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(flags), self.words * 64), dtype=np.uint8)
        wide[:, :flags.shape[1]] = flags
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def match(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, patterns): which patterns fit each whole text."""
        length = np.diff(starts)
        order = np.argsort(-length, kind="stable")
        begin, ordered = starts[:-1][order], length[order]
        state = np.tile(self.start, (len(order), 1))
        for t in range(int(ordered[0]) if len(ordered) else 0):
            n = int(np.searchsorted(-ordered, -t, side="left"))  # texts longer than t
            byte, now = data[begin[:n] + t], state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[byte]) | (now & self.loop[byte])
        at = np.array(self.accept, dtype=np.int64)
        hit = (state[:, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
        out = np.zeros(hit.shape, dtype=bool)
        out[order] = hit.astype(bool)
        return out


def _judge(rules, otherwise, default):
    patterns, owner = [], []
    for i, r in enumerate(rules):
        patterns += r.globs()
        owner += [i] * len(r.globs())
    ranked = sorted(range(len(rules)), key=lambda i: -len(rules[i].name))
    extra = [(g, v) for g, v in otherwise]

    def run(batches):
        automaton = Automaton([*patterns, *(g for g, _ in extra)])
        for batch in batches:
            url = batch.column("canonical")
            for row, data, starts in chunks(url, 1 << 18):
                hit = automaton.match(data, starts)
                n = len(hit)
                rule, verdict = np.full(n, None, dtype=object), np.full(n, default, dtype=object)
                for k, (_, v) in reversed(list(enumerate(extra))):
                    verdict[hit[:, len(owner) + k]] = v
                for i in reversed(ranked):
                    fits = hit[:, [k for k, o in enumerate(owner) if o == i]].any(axis=1)
                    rule[fits], verdict[fits] = rules[i].name, rules[i].verdict
                part = batch.slice(row, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("host"), part.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                    names=["page_id", "host", "path", "rule", "verdict"])
    return run


def judge_urls(pages: DataFrame, rules: Sequence[Rule], otherwise: Sequence[tuple[str, str]] = (), default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row.

    The host lies between the first ``://`` and the next "/", "?", "#" or the end, A-Z in lower case; the path goes
    on to "?", "#" or the end.  A null url, or one without ``://``, has both empty.  Of the rules that fit, the
    longest wins (of equally long ones the first).  Where none fits, rule is null and the verdict is that of the first
    glob of ``otherwise`` that fits host and path, else ``default``.  Rows are judged one by one: repeated rows and null ids stay.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring_index(
        url.substr(F.instr(url, "://") + 3, F.length(url)), "#", 1), "?", 1)).otherwise(F.lit(""))
    cut = pages.select(F.col(id_col).alias("page_id"), rest.alias("rest"))
    slash = F.instr("rest", "/")
    host = F.when(slash > 0, F.col("rest").substr(F.lit(1), slash - 1)).otherwise(F.col("rest"))
    path = F.when(slash > 0, F.col("rest").substr(slash, F.length("rest"))).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = cut.select("page_id", F.translate(host, upper, lower).alias("host"), path.alias("path"))
    kind = dict(pages.select(F.col(id_col)).dtypes).popitem()[1]
    return parts.withColumn("canonical", F.concat("host", "path")).mapInArrow(
        _judge(list(rules), list(otherwise), default), f"page_id {kind}, host string, path string, rule string, verdict string")
