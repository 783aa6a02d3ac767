"""What a model has to offer, and deterministic defaults that need none.

Models run behind Arrow; each Python worker makes its model once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: Sequence[int]) -> str: ...

    def offsets(self, text: str) -> list[int]:
        """Character at which each token of text starts."""


class BoundaryModel(Protocol):
    """A tokenizer with a classifier of its tokens."""

    def offsets(self, text: str) -> list[int]: ...

    def predict(self, text: str) -> list[int]:
        """For each token 1 where a unit begins, else 0."""


class Embedder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Segmenter(Protocol):
    def boundaries(self, line: str) -> list[int]:
        """Character offsets at which new units begin, the first one excepted."""


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class HashedEmbedder:
    """Unit vector of lower-case token counts in hashed buckets."""

    #: Tokens whose buckets are remembered.
    REMEMBERED = 200_000

    def __init__(self, dim: int = 256):
        self.name, self.dim = "hashed", dim
        self._known: dict[str, int] = {}

    def _bucket(self, token: str) -> int:
        if (b := self._known.get(token)) is None:
            if len(self._known) >= self.REMEMBERED:
                self._known.clear()
            b = self._known[token] = int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % self.dim
        return b

    def encode_array(self, texts: list[str]) -> np.ndarray:
        rows, places = [], []
        for i, text in enumerate(texts):
            mine = [self._bucket(t) for t in text.lower().split()]
            places += mine
            rows += [i] * len(mine)
        cells = np.array(rows, np.int64) * self.dim + np.array(places, np.int64)
        v = np.bincount(cells, minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(float)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return v / np.where(norm > 0, norm, 1)

    def encode(self, texts: list[str]) -> list[list[float]]:
        return self.encode_array(texts).tolist()


class RuleSegmenter:
    """A unit begins after , ; : or before a connective."""

    CONNECTIVES = ("and", "but", "because", "which", "when", "while", "although", "if", "that")
    _START = re.compile(r"(?<=[,;:])\s+(?=\S)|\s+(?=(?:" + "|".join(CONNECTIVES) + r")\s)")

    def boundaries(self, line: str) -> list[int]:
        return [m.end() for m in self._START.finditer(line)]


class OverlapGenerator:
    """Answers by how many of the claim's words the evidence holds."""

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            claim = set((re.findall(r"^Claim: (.*)$", p, re.M) or [""])[-1].lower().split())
            found = p.partition("Evidence:\n")[2].lower()
            share = sum(w in found for w in claim) / len(claim) if claim else 0.0
            out.append("SUPPORTS" if share >= 0.8 else "REFUTES" if share >= 0.5 else "NOT ENOUGH INFO")
        return out


class PredictedSegmenter:
    """Units begin at tokens that a boundary model predicts 1; the first token's prediction doesn't
    count. A line whose predictions fail or don't match its tokens is one unit."""

    def __init__(self, model: Callable[[], BoundaryModel]):
        self.model = model()

    def boundaries(self, line: str) -> list[int]:
        try:
            starts, predicted = self.model.offsets(line), self.model.predict(line)
        except Exception:
            return []
        return [o for o, p in zip(starts[1:], predicted[1:], strict=True) if p == 1] if len(starts) == len(predicted) else []
