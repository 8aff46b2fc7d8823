"""Repairs against trying all edits."""

import hashlib
import random
import re
import zlib

import pytest

from sortline.llm import repair as R

SHAPE = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def search(rows, marks):
    """Least (cost, audit, pieces), by all ways to edit; more than two insertions in a place lead nowhere new."""
    done = {"": (0, "", ())}  # by initials so far, of which the last two and the first matter
    short = lambda s: (s[:1] == "s", len(s) > 1, s[-1:])

    def insert(states):
        out = dict(states)
        for _ in range(3):
            for s, (cost, audit, said) in list(out.items()):
                for name in ("user", "assistant"):
                    put(out, s + name[0], (cost + 2, audit + "I", (*said, f"{name}:")))
        return out

    def put(out, s, got):
        if re.fullmatch(r"(s?(ua)*u?)?", s):
            same = [x for x in out if short(x) == short(s)]
            if all(got < out[x] for x in same):
                for x in same:
                    del out[x]
                out[s] = got

    states = insert(done)
    for (_, role, text), mark in zip(rows, marks):
        after = {}
        for s, (cost, audit, said) in states.items():
            put(after, s, (cost + 3, audit + "D", said))
            if mark not in ("blank", "duplicate"):
                more = mark == "truncated"
                if role[:1] in "sua" and role:
                    put(after, s + role[0], (cost + more, audit + "K", (*said, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    put(after, s + name[0], (cost + 2 + more, audit + "R", (*said, f"{name}:{text}")))
        states = insert(after)
    return min(v for s, v in states.items() if GRAMMAR.fullmatch(s))


def brute(conversations):
    by = {}
    for conv, turn, role, text in conversations:
        spelled = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(spelled.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = by.setdefault(conv, [])
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            own += [row] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marks = faults(rows)
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, said = search(rows, marks) if rows else (0, "", ())
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(marks.count(f) for f in R.FAULTS), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def ours(spark, rows):
    return sorted(map(tuple, R.repair(spark.createDataFrame(rows, SHAPE)).collect()), key=repr)


def conversations(seed, n):
    rng, out = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "u", "assist"])
            role = role if rng.random() < 0.5 else ["user", "assistant"][turn % 2]
            text = rng.choice(["Hi.", "Hi", " \t\n", "", None, "ok!\n", "What?\x0b", "é…", "a.b", "long " * 50 + "."])
            out.append((conv if conv else None, turn if rng.random() < 0.9 else rng.choice([None, 0, 3]), role, text))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_trying_all_edits(spark, seed):
    rows = conversations(seed, 120)
    assert ours(spark, rows) == brute(rows)


def test_long_conversations_lie_in_many_spans(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "tool"]), f"said {t % 50}" + rng.choice([".", "", "!"])) for t in range(1500)]
    rows += [(8, 1, "user", "same.")] * 700 + [(8, None, "user", "same.")] * 30
    want = brute(rows)
    assert ours(spark, rows) == want
    monkeypatch.setattr(R, "SPAN_ROWS", 3)
    assert ours(spark, rows) == want


def test_empty_dropped_and_clashing(spark):
    assert ours(spark, []) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert ours(spark, [(5, gone, "user", "Hi.")]) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    wide = spark.createDataFrame([(5, gone, "user", "Hi.", 1, "x", "y")], SHAPE + ", n int, fault string, part string")
    assert R.repair(wide).count() == 1


@pytest.mark.parametrize("seed", range(30))
def test_any_split_of_a_span_gives_the_same_cell(seed):
    """The chart over all splits, as of a context-free grammar, against halves."""
    rng = random.Random(seed)
    cells = [R.cell_of(rng.choice("suax"), rng.choice([None, None, *R.FAULTS])) for _ in range(rng.randrange(1, 8))]
    n = len(cells)
    chart = {(i, i + 1): c for i, c in enumerate(cells)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            ways = [R.joined(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
            assert all(w == ways[0] for w in ways)
            chart[i, i + length] = R.least(ways)
    assert R.parse(cells) == chart[0, n]
    assert "".join(a for _, a in R.split(cells)) == R.best(chart[0, n])[1]
