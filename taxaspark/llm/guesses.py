"""How many guesses a password costs: minimum-cost segmentation."""

from __future__ import annotations

import math
import re
from functools import lru_cache

# Words that password lists put first, by rank; ``secrets.corpus_words`` puts a corpus's own words after them.
COMMON_WORDS = (
    "password", "admin", "welcome", "login", "letmein", "master", "hello", "secret", "test", "user", "root", "guest", "monkey", "dragon",
    "sunshine", "princess", "football", "baseball", "shadow", "superman", "batman", "trustno", "access", "flower", "summer", "winter",
    "spring", "autumn", "love", "house", "computer", "internet", "server", "default", "system", "public", "private", "changeme", "example",
    "sample", "token", "key", "pass", "passwd", "required", "optional", "none", "null", "true", "false", "string", "value", "your", "here",
    "enter", "insert", "the", "and", "for", "with", "from", "that", "this", "not", "are", "was", "will", "have", "please", "change", "reset",
)
# Keys next to each other in rows, and the alphabet as one more row.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
# Signs that stand for letters.
SIGNS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_NEXT_KEY = {(a, b): step for row in KEY_ROWS for step, pairs in ((1, zip(row, row[1:], strict=False)), (-1, zip(row[1:], row, strict=False))) for a, b in pairs}
_DATES = (
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"), math.log10(366 * 200)),
    (re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"), math.log10(366 * 200)),
    (re.compile(r"(?:19|20)\d\d"), math.log10(200)),
)
_STARTS = math.log10(sum(map(len, KEY_ROWS)))
LONGEST_UNIT = 8


def char_cost(c: str) -> float:
    """log10 of the size of the class that a guesser has to try."""
    if c.isdigit():
        return 1.0
    if c.isascii():
        return math.log10(26 if c.isalpha() else 33)
    return 2.0


def word_cost(part: str, ranks: dict[str, int]) -> float | None:
    """log10 of rank, times two for capitals (more if they are scattered), times two for each sign that stands for a letter."""
    low = part.lower()
    plain = "".join(SIGNS.get(c, c) for c in low)
    rank = ranks.get(low) or ranks.get(plain)
    if rank is None:
        return None
    upper = sum(c.isupper() for c in part)
    cost = math.log10(rank + 1)
    if upper:
        cost += math.log10(2 if upper == len(part) or (upper == 1 and part[0].isupper()) else 2 * math.comb(len(part), upper))
    return cost + sum(a != b for a, b in zip(low, plain, strict=True)) * math.log10(2) * (low not in ranks)


class Ranked:
    """Many words with their ranks; unlike a tuple, cheap to hand from call to call."""

    def __init__(self, words: tuple[str, ...]):
        self.ranks, self.longest = _ranked.__wrapped__(words)


@lru_cache(maxsize=4)
def _ranked(words: tuple[str, ...]) -> tuple[dict[str, int], int]:
    return {w: i for i, w in reversed(list(enumerate(words, 1)))}, max(map(len, words), default=0)


def spans(value: str, words: tuple[str, ...] | Ranked = COMMON_WORDS) -> list[tuple[int, int, float]]:
    """(start, end, log10 guesses) of every word, date, longest keyboard walk and longest repeat in ``value``."""
    ranks, longest = (words.ranks, words.longest) if isinstance(words, Ranked) else _ranked(words)
    n, low, out = len(value), value.lower(), []
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            if (cost := word_cost(value[i:j], ranks)) is not None:
                out.append((i, j, cost))
        for pattern, cost in _DATES:
            if m := pattern.match(value, i):
                out.append((i, m.end(), cost + math.log10(4) * bool(m.lastindex and m[1])))
    i = 0
    while i < n - 1:  # walks: each step to a neighbouring key, costlier where the direction turns
        j, turns, way = i, 0, 0
        while j + 1 < n and (step := _NEXT_KEY.get((low[j], low[j + 1]))):
            turns += step != way
            way, j = step, j + 1
        if j - i >= 2:
            out.append((i, j + 1, _STARTS + turns * math.log10(2) + math.log10(j + 1 - i)))
        i = max(j, i + 1)
    for unit in range(1, min(LONGEST_UNIT, n // 2) + 1):
        i = 0
        while i + unit < n:
            j = i
            while j + unit < n and value[j] == value[j + unit]:
                j += 1
            times = (j - i) // unit + 1
            if times > 1 and times * unit >= 3:
                out.append((i, i + times * unit, log10_guesses(value[i : i + unit], words) + math.log10(times)))
            i = max(j, i + 1) if j > i else i + 1
    return out


def log10_guesses(value: str, words: tuple[str, ...] | Ranked = COMMON_WORDS) -> float:
    """Cheapest way to put ``value`` together from spans and single brute-force characters."""
    starting: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in spans(value, words) if len(value) > 1 else ():
        starting.setdefault(i, []).append((j, cost))
    best = [0.0] + [math.inf] * len(value)
    for i, c in enumerate(value):
        best[i + 1] = min(best[i + 1], best[i] + char_cost(c))
        for j, cost in starting.get(i, ()):
            best[j] = min(best[j], best[i] + cost)
    return best[-1]
