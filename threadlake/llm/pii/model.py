"""A semi-Markov conditional random field over candidate segments.

A segmentation is a set of segments that don't overlap; all other text is outside. Its score is the sum of its
segments' feature weights and of a weight for each pair of types that follow each other. Dynamic programming over the
ends of segments finds the best segmentation (boundaries and types together), and in training the sum over all.
Segments are bounded in length by their generators, so each step looks back over a bounded number of candidates.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache
from math import exp, log
from pathlib import Path

from threadlake.llm.pii.spans import TYPES, Lexicon, Segment, candidates

MODEL = Path(__file__).with_name("model.json")


class SemiCrf:
    def __init__(self, weights: dict[str, float], lexicon: Lexicon):
        self.weights, self.lexicon = weights, lexicon

    def score(self, s: Segment) -> float:
        w = self.weights
        return w.get(f"bias:{s.kind}", 0.0) + sum(w.get(f, 0.0) for f in s.features)

    def pair(self, a: str | None, b: str) -> float:
        return self.weights.get(f"{a}>{b}", 0.0) if a else 0.0

    def best(self, segments: list[Segment]) -> list[Segment]:
        """The best segmentation; ties go to the one that covers more.

        For each type, the best segmentation that ends in it is kept per prefix of the segments, so that the work is
        linear in the candidates, however long the text.
        """
        if len(segments) < 2:
            return [s for s in segments if self.score(s) > 0]
        order = sorted(set(segments), key=lambda s: (s.end, s.start, s.kind))
        ends = [s.end for s in order]
        # tops[i][kind]: (score, characters covered, last segment) of the best segmentation of the first i segments that ends in kind.
        tops: list[dict[str | None, tuple[float, int, int]]] = [{None: (0.0, 0, -1)}]
        back: list[int] = []
        for i, s in enumerate(order):
            before = tops[bisect_right(ends, s.start, 0, i)]
            score, covered, last = max((v + self.pair(k, s.kind), c, n) for k, (v, c, n) in before.items())
            mine = (score + self.score(s), covered + s.end - s.start, i)
            back.append(last)
            tops.append(tops[-1] | {s.kind: mine} if mine[:2] > tops[-1].get(s.kind, (float("-inf"), 0))[:2] else tops[-1])
        _, _, last = max(tops[-1].values())
        chosen = []
        while last >= 0:
            chosen.append(order[last])
            last = back[last]
        return chosen[::-1]

    def find(self, text: str, kinds: frozenset[str] = frozenset(TYPES)) -> list[Segment]:
        found = candidates(text, self.lexicon, kinds)
        return [s for s in self.best(found) if s.kind in kinds] if found else []

    # Training

    def expected(self, segments: list[Segment]) -> tuple[float, dict[str, float]]:
        """Log of the sum over all segmentations, and the expected features."""
        order = sorted(segments, key=lambda s: (s.end, s.start, s.kind))
        n = len(order)
        own = [self.score(s) for s in order]
        forward = [0.0] * n
        for i, s in enumerate(order):
            forward[i] = own[i] + _logsum([0.0, *(forward[j] + self.pair(order[j].kind, s.kind) for j in range(i) if order[j].end <= s.start)])
        backward = [0.0] * n
        for i in range(n - 1, -1, -1):
            s = order[i]
            backward[i] = _logsum([0.0, *(self.pair(s.kind, order[k].kind) + own[k] + backward[k] for k in range(i + 1, n) if order[k].start >= s.end)])
        z = _logsum([0.0, *forward])
        out: dict[str, float] = defaultdict(float)
        for i, s in enumerate(order):
            p = exp(forward[i] + backward[i] - z)
            for f in (f"bias:{s.kind}", *s.features):
                out[f] += p
            for j in range(i):
                if order[j].end <= s.start:
                    out[f"{order[j].kind}>{s.kind}"] += exp(forward[j] + self.pair(order[j].kind, s.kind) + own[i] + backward[i] - z)
        return z, out

    @staticmethod
    def observed(gold: list[Segment]) -> dict[str, float]:
        out: dict[str, float] = defaultdict(float)
        gold = sorted(gold)
        for s in gold:
            for f in (f"bias:{s.kind}", *s.features):
                out[f] += 1
        for a, b in zip(gold, gold[1:], strict=False):
            out[f"{a.kind}>{b.kind}"] += 1
        return out

    def save(self, path: Path = MODEL) -> None:
        path.write_text(json.dumps({"given": sorted(self.lexicon.given), "endings": sorted(self.lexicon.endings), "weights": {k: round(v, 3) for k, v in sorted(self.weights.items())}}, ensure_ascii=False, indent=0) + "\n")


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + log(sum(exp(v - top) for v in values))


@lru_cache(maxsize=2)
def load(path: str = str(MODEL)) -> SemiCrf:
    saved = json.loads(Path(path).read_text())
    return SemiCrf(saved["weights"], Lexicon(frozenset(saved["given"]), frozenset(saved["endings"])))
