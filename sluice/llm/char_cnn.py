"""A character convolutional network in numpy: a value of up to ``VALUE`` characters between the characters around it, to one logit.

Characters are embedded, one convolution of ``WIDTH`` characters runs over all of them, and its filters are pooled by their
greatest and mean answer over the value and their greatest over the context.
"""

from __future__ import annotations

import numpy as np

BEFORE, VALUE, AFTER = 20, 64, 8
LENGTH = BEFORE + VALUE + AFTER
SYMBOLS, EMBEDDED, WIDTH, FILTERS = 97, 8, 5, 24
#: Stands for "nothing here".
PAD = 0


def encode(rows: list[tuple[str, str, str]], blank_context: bool = False) -> np.ndarray:
    """(rows, LENGTH) symbols: the end of what stands before, the value from its first place on, the beginning of what follows."""
    out = np.zeros((len(rows), LENGTH), dtype=np.int64)
    for k, (before, value, after) in enumerate(rows):
        parts = [(BEFORE, value[:VALUE])] if blank_context else [(BEFORE - len(before[-BEFORE:]), before[-BEFORE:]), (BEFORE, value[:VALUE]), (BEFORE + VALUE, after[:AFTER])]
        for at, part in parts:
            codes = np.frombuffer(part.encode("ascii", "replace"), dtype=np.uint8).astype(np.int64)
            out[k, at:at + len(codes)] = np.where((codes >= 32) & (codes < 127), codes - 31, SYMBOLS - 1)
    return out


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.weights = {
            "embed": rng.normal(0, 0.5, (SYMBOLS, EMBEDDED)), "filter": rng.normal(0, (WIDTH * EMBEDDED) ** -0.5, (WIDTH * EMBEDDED, FILTERS)),
            "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.2, 3 * FILTERS), "constant": np.zeros(1)}
        self.weights["embed"][PAD] = 0

    def _forward(self, x: np.ndarray):
        w = self.weights
        pad = WIDTH // 2
        embedded = np.pad(w["embed"][x], ((0, 0), (pad, pad), (0, 0)))
        columns = np.concatenate([embedded[:, k:k + LENGTH] for k in range(WIDTH)], axis=2)
        answer = np.maximum(columns @ w["filter"] + w["bias"], 0)
        inside = x[:, BEFORE:BEFORE + VALUE] != PAD
        size = np.maximum(inside.sum(axis=1), 1)[:, None]
        value = answer[:, BEFORE:BEFORE + VALUE] * inside[:, :, None]
        context = np.concatenate([answer[:, :BEFORE], answer[:, BEFORE + VALUE:]], axis=1)
        pooled = np.concatenate([value.max(axis=1), value.sum(axis=1) / size, context.max(axis=1)], axis=1)
        return columns, answer, inside, size, value, context, pooled, pooled @ w["out"] + w["constant"][0]

    def logits(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        return np.concatenate([self._forward(x[k:k + batch])[-1] for k in range(0, len(x), batch)]) if len(x) else np.zeros(0)

    def _slopes(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        w = self.weights
        columns, answer, inside, size, value, context, pooled, logit = self._forward(x)
        off = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) * weight / len(x)
        back = off[:, None] * w["out"]
        high, mean, around = back[:, :FILTERS], back[:, FILTERS:2 * FILTERS], back[:, 2 * FILTERS:]
        slope = np.zeros_like(answer)
        rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)
        slope[:, BEFORE:BEFORE + VALUE] = inside[:, :, None] * (mean / size)[:, None, :]
        slope[rows, BEFORE + value.argmax(axis=1), filters] += high
        place = context.argmax(axis=1)
        slope[rows, np.where(place < BEFORE, place, place + VALUE), filters] += around
        slope *= answer > 0
        flat = slope.reshape(-1, FILTERS)
        down = (flat @ w["filter"].T).reshape(len(x), LENGTH, WIDTH, EMBEDDED)
        embed = np.zeros_like(w["embed"])
        for k in range(WIDTH):
            at = k - WIDTH // 2
            seen = x[:, max(0, at):LENGTH + min(0, at)]
            part = down[:, max(0, -at):LENGTH - max(0, at), k].reshape(-1, EMBEDDED)
            for d in range(EMBEDDED):
                embed[:, d] += np.bincount(seen.reshape(-1), weights=part[:, d], minlength=SYMBOLS)
        embed[PAD] = 0
        return {"embed": embed, "filter": columns.reshape(-1, WIDTH * EMBEDDED).T @ flat, "bias": flat.sum(axis=0), "out": pooled.T @ off, "constant": np.array([off.sum()])}

    def vector(self, *moments: dict[str, np.ndarray]) -> np.ndarray:
        """The weights, and after them the moments, as one array."""
        return np.concatenate([part[name].reshape(-1) for part in (self.weights, *moments) for name in self.weights])

    @classmethod
    def from_vector(cls, vector: np.ndarray) -> tuple[Network, list[dict[str, np.ndarray]]]:
        """What ``vector`` made one array of."""
        network, at, parts = cls(), 0, []
        while at < len(vector):
            parts.append({})
            for name, old in network.weights.items():
                parts[-1][name] = vector[at:at + old.size].reshape(old.shape).copy()
                at += old.size
        network.weights = parts[0]
        return network, parts[1:]

    def moments(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        return first, second

    def learn(self, epoch: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray, first: dict[str, np.ndarray], second: dict[str, np.ndarray],
              batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> None:
        """One epoch (from 0) of Adam over shuffled batches, towards the least weighted logistic loss; ``first`` and ``second`` are its moments."""
        rng = np.random.default_rng(seed)
        order = [rng.permutation(len(x)) for _ in range(epoch + 1)][-1]
        t = epoch * -(-len(x) // batch)
        for k in range(0, len(x), batch):
            t += 1
            part = order[k:k + batch]
            for name, slope in self._slopes(x[part], y[part], weight[part]).items():
                slope = slope + decay * self.weights[name]
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.999 * second[name] + 0.001 * slope ** 2
                self.weights[name] -= rate * (first[name] / (1 - 0.9 ** t)) / (np.sqrt(second[name] / (1 - 0.999 ** t)) + 1e-8)
