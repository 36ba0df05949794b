"""Lines of a text that nearly equal a line of another one (section 2.12)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence
from difflib import SequenceMatcher

#: Length of the runs that index a pool of lines.
GRAM = 4


class Pool:
    """Lines of one text, found by the runs of GRAM characters that a near-equal line must share with them.

    Two lines of L characters together whose matching blocks make a ratio of ``least`` leave at most (1 - least) L characters unmatched, and so
    have at most one block more than that.  Their blocks hold least L / 2 characters, so at least so many runs of the one occur in the other, less GRAM - 1 for
    each block.  Only a line's rarest runs are looked up, one more than may fail.
    """

    def __init__(self, lines: Sequence[str], least: float, apart: int):
        self.lines, self.least, self.apart = list(dict.fromkeys(lines)), least, apart
        self.at: dict[str, list[int]] = defaultdict(list)
        self.short: dict[int, list[int]] = defaultdict(list)
        for n, line in enumerate(self.lines):
            for g in {line[i : i + GRAM] for i in range(len(line) - GRAM + 1)}:
                self.at[g].append(n)
            self.short[len(line)].append(n)

    def shared_runs(self, total: float) -> int:
        """How many runs near-equal lines of so many characters together share at least; under 1 if they may share none."""
        unmatched = int((1 - self.least) * total + 1e-9)
        return int(self.least * total / 2 - 1e-9) + 1 - (GRAM - 1) * (unmatched + 1)

    def candidates(self, line: str) -> set[int]:
        shortest = self.least / (2 - self.least) * len(line)  # a shorter line cannot reach the ratio
        found = set()
        runs = [line[i : i + GRAM] for i in range(len(line) - GRAM + 1)]
        needed = min((self.shared_runs(len(line) + n) for n in range(int(shortest), int(len(line) / shortest * len(line)) + 2)), default=0) if shortest else 0
        if needed >= 1:
            runs.sort(key=lambda g: len(self.at.get(g, ())))
            for g in runs[: len(runs) - needed + 1]:
                found.update(self.at.get(g, ()))
            return found
        # so short that no run need be shared: lines of nearly its length
        for n in range(int(shortest), 2 * len(line) - int(shortest) + 3):
            found.update(self.short.get(n, ()))
        return found

    def holds(self, line: str) -> bool:
        """Whether a line of the pool has a matching-block ratio from ``least`` on and a length less than ``apart`` away."""
        letters = Counter(line)
        for n in self.candidates(line):
            other = self.lines[n]
            total = len(line) + len(other)
            if abs(len(other) - len(line)) >= self.apart or not total or 2 * sum((letters & Counter(other)).values()) < self.least * total:
                continue
            if SequenceMatcher(None, line, other).ratio() >= self.least:
                return True
        return False


def without_near(lines: Sequence[str], pool: Sequence[str], least: float = 0.9, apart: int = 30) -> list[str]:
    """The lines that nearly equal none of the pool."""
    if not lines or not pool:
        return list(lines)
    index = Pool(pool, least, apart)
    return [x for x in lines if not index.holds(x)]
