import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from taxaspark.llm import repair

SCHEMA = "conv_id int, turn int, role string, text string"


def first_fault(said, i):
    role, text = said[i]
    seen = re.sub(r"[\x20\x09-\x0D]", "", text)
    return "blank" if not seen else "duplicate" if (role, text) in said[:i] else None if seen[-1] in ".!?" else "truncated"


def brute(said):
    """(cost, audit, lines): every list of edits tried, by a search over (rows done, initials so far as a state)."""
    best = {}

    def legal(initials):
        return re.fullmatch("(s?(ua)+)?", initials) is not None

    def go(i, initials, cost, audit, lines):
        if cost > 3 * len(said) or (audit.count("I") > len(said) + 2):
            return
        if i == len(said) and legal(initials):
            best.setdefault("x", []).append((cost, audit, lines))
        prefixes = any(legal(initials + more) for more in ("", "a", "ua"))
        if not prefixes:
            return
        if not audit.endswith("III"):
            for r in ("user", "assistant"):
                go(i, initials + r[0], cost + 2, audit + "I", [*lines, r + ":"])
        if i == len(said):
            return
        role, text = said[i]
        fault = first_fault(said, i)
        go(i + 1, initials, cost + 3, audit + "D", lines)
        if fault in (None, "truncated"):
            more = int(fault == "truncated")
            if role[:1] in ("s", "u", "a"):
                go(i + 1, initials + role[:1], cost + more, audit + "K", [*lines, f"{role}:{text}"])
            for r in ("user", "assistant"):
                go(i + 1, initials + r[0], cost + 2 + more, audit + "R", [*lines, f"{r}:{text}"])

    go(0, "", 0, "", [])
    return min(best["x"])


def made(spark, rows, partitions=3):
    turns = spark.createDataFrame(rows, SCHEMA).select(*[F.lit(1).alias(c) for c in ("place", "fault", "conv", "block", "edits")], "*").repartition(partitions)
    found = repair.faults(turns)
    edits, costs = repair.cheapest_edits(found)
    hashes = {r["conv"]: r["sha256"] for r in repair.transcripts_sha256(repair.repaired(found, edits)).collect()}
    return {r["conv"]: (*r[1:], hashes.get(r["conv"], hashlib.sha256(b"").hexdigest())) for r in repair.report(found, edits, costs).collect()}


def expected(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text, turn))
    want = {}
    for c, listed in by.items():
        listed.sort(key=lambda r: r[:4])
        said = [r[2:4] for r in listed]
        turns = {r[4] for r in listed} - {None}
        kinds = [first_fault(said, i) for i in range(len(said))]
        illegal = sum((a[0][:1], b[0][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in itertools.pairwise(said))
        cost, audit, lines = brute(said) if len(said) <= 6 else forward(said)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        want[c] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return want


def forward(said):
    """The least (cost, audit) by state, row after row; checked against ``brute`` below."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(now):
        now = dict(now)
        for _ in range(2):
            for q, (cost, audit, lines) in list(now.items()):
                for r in ("user", "assistant"):
                    to = moves.get((q, r[0]))
                    if to:
                        now[to] = min(now.get(to, (1e9,)), (cost + 2, audit + "I", [*lines, r + ":"]), key=lambda x: x[:2])
        return now

    now = {"": (0, "", [])}
    seen = set()
    for role, text in said:
        clean = re.sub(r"[\x20\x09-\x0D]", "", text)
        must, more = not clean or (role, text) in seen, int(bool(clean) and clean[-1] not in ".!?")
        seen.add((role, text))
        new = {}

        def offer(q, cost, audit, lines, new=new):
            new[q] = min(new.get(q, (1e9,)), (cost, audit, lines), key=lambda x: x[:2])

        for q, (cost, audit, lines) in inserted(now).items():
            offer(q, cost + 3, audit + "D", lines)
            if not must:
                if (q, role[:1]) in moves:
                    offer(moves[q, role[:1]], cost + more, audit + "K", [*lines, f"{role}:{text}"])
                for r in ("user", "assistant"):
                    if (q, r[0]) in moves:
                        offer(moves[q, r[0]], cost + 2 + more, audit + "R", [*lines, f"{r}:{text}"])
        now = new
    return min((v for q, v in inserted(now).items() if q in ("", "a")), key=lambda x: x[:2])


ROLES = ["user", "assistant", "system", "tool", "", "Sys", "user", "assistant"]
TEXTS = ["", " \t\n", "Yes.", "no", "Why?\n", "é", "Ha! ", "x" * 30, "..", "\x0b"]


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    return [(c, rng.choice([None, *range(6)]) if rng.random() < 0.2 else t, rng.choice(ROLES), rng.choice(TEXTS)) for c in range(conversations) for t in range(rng.randint(1, longest))]


def test_forward_minimum_is_the_search():
    rng = random.Random(4)
    for _ in range(150):
        said = [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randint(0, 5))]
        cost, audit, lines = forward(said)
        assert (cost, audit, lines) == tuple(brute(said))


def test_walk_gives_least_cheapest_edits_from_every_state():
    rng = random.Random(8)
    for _ in range(200):
        codes = bytes(rng.choices([0, 1, 2, 3, 8, 9, 10, 4, 5], k=rng.randint(1, 12)))
        cut = rng.randint(0, len(codes))
        whole = repair.walk(codes, repair.END)
        after = repair.END
        for code in reversed(codes[cut:]):
            after = repair.before_row(code, after)
        first, second = repair.walk(codes[:cut], after), repair.walk(codes[cut:], repair.END)
        assert whole == [(second[s][0], told + second[s][1]) for s, told in first]


@pytest.mark.parametrize("first_block", [1, 64])
def test_against_the_search(spark, monkeypatch, first_block):
    """With blocks of one row and more, most conversations are cut; the last ones are longer than any first block."""
    monkeypatch.setattr(repair, "FIRST_BLOCK", first_block)
    rng = random.Random(2)
    rows = random_rows(1, 60, 6) + [(100, None, None, None), (101, 5, "user", "a."), (101, 5, "user", "a."), (None, 0, "user", "no id"), (None, 1, "assistant", "none.")]
    rows += [(102, t, rng.choice(ROLES), f"{rng.choice(TEXTS)}{rng.choice(['', t])}") for t in range(400)]
    rows += [(103, t, ("user", "assistant")[t % 2], "same.") for t in range(300)] + [(104, 0, "user", "long " * 50000), (104, 2**31 - 1, "assistant", "end.")]
    assert made(spark, rows) == expected(rows)


def test_partitions_change_nothing_and_no_rows(spark):
    rows = random_rows(5, 30, 6)
    assert made(spark, rows, 1) == made(spark, rows, 7)
    assert made(spark, [], 1) == {}
