import random

import pytest
from pyspark.sql import functions as F

from toposim.llm import repair
from toposim.llm.lattice import FINAL, NEXT, moves, solve


def brute(turns, start=0, finals=FINAL):
    """Least (cost, letters) by trying every edit at every turn, last turn first."""
    after = {s: None for s in range(4)}
    for i in range(len(turns), -1, -1):
        here = {}
        for s in range(4):
            ways = [(0, "")] if i == len(turns) and s in finals else []
            if i < len(turns):
                ways += [(c + after[t][0], e + after[t][1]) for e, c, t in moves(*turns[i])[s] if after[t]]
            here[s] = min(ways, default=None)
        after = {}
        for s in range(4):
            t, ways = s, []
            for inserts in range(5):
                if here[t]:
                    ways.append((3 * inserts + here[t][0], "I" * inserts + here[t][1]))
                t = NEXT[t]
            after[s] = min(ways, default=None)
    return after[start]


KINDS = [(0, "u", 0), (0, "a", 0), (0, "s", 0), (0, "u", 1), (0, "a", 1), (1, "", 0), (3, "", 0), (0, "x", 0), (0, "", 0)]


def test_search_equals_brute_force():
    rnd = random.Random(3)
    for k in range(4000):
        turns = tuple(rnd.choice(KINDS[:2] if k % 3 == 0 else KINDS) for _ in range(rnd.randint(0, 9)))
        start, finals = rnd.choice([0, 0, 1, 2, 3]), rnd.choice([FINAL, (0,), (1,), (2,), (3,)])
        assert solve(turns, start, finals) == brute(turns, start, finals)


def test_long_lists():
    rnd = random.Random(5)
    turns = tuple(rnd.choice(KINDS) for _ in range(3000))
    assert solve(turns) == brute(turns)
    assert solve(((0, "u", 0), (0, "a", 0)) * 1500) == (0, "K" * 3000)


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def chats(spark):
    """One conversation holds most rows; others are small; odd rows."""
    rnd = random.Random(7)
    role = lambda: rnd.choice(["user", "assistant", "assistant", "system", "tool"])
    text = lambda: rnd.choice(["Yes.", "No!", "and then", "", " \t", f"say {rnd.random()}."])
    rows = [(1, t, role(), text()) for t in range(400)] + [(c, t, role(), text()) for c in range(2, 40) for t in range(rnd.randint(1, 6))]
    rows += [(None, 0, "user", "Hi."), (None, 1, None, None), (50, None, "user", "a."), (50, None, "user", "a."), (50, 5, "assistant", "b.")]
    rows += [(51, 3, "", "x."), (52, 0, "user", "q."), (52, 0, "user", "q."), (52, 0, "user", "q.")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_segments_do_not_change_results(chats, spark):
    whole = _rows(repair.report(repair.repair(chats.coalesce(1), segment=10_000), chats))
    for segment in (1, 3, 64):
        assert _rows(repair.report(repair.repair(chats.repartition(7), segment=segment), chats)) == whole


def test_report_equals_brute_force(chats):
    got = {r.conv_id: r for r in repair.report(repair.repair(chats, segment=16), chats).collect()}
    by = {}
    for r in chats.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    assert set(got) == set(by)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns, kinds = set(), [], []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            kind = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            kinds.append(kind)
            turns.append((1, "", 0) if kind in ("blank", "duplicate") else (0, role[:1], int(kind == "truncated")))
        cost, letters = brute(turns)
        r = got[conv]
        assert (r.cost, r.audit) == (cost, letters)
        assert [r.blank, r.duplicate, r.truncated] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        initials = [x[1][:1] for x in rows]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        ts = [x[0] for x in rows if x[0] is not None]
        assert r.gaps == (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0)


def test_edits_give_the_wanted_order(chats):
    edits = repair.repair(chats, segment=8).where("conv_id = 1 AND role IS NOT NULL").orderBy("part", "seg", "pos").collect()
    import re
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in edits))


def test_damage_rules(spark):
    import zlib
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    src = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if k:
            row = (c, t, "user" if k == 4 else role, "" if k == 1 else "One Two" if k == 2 and c is not None else text)
            want += [row] * (2 if k == 3 else 1)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in repair.damage(src).collect())


def test_empty_dropped_and_clashing(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert repair.report(repair.repair(none), none).count() == 0
    ids = spark.createDataFrame([(9,)], "conv_id long")
    r = repair.report(repair.repair(none), ids).first()
    assert (r.gaps, r.cost, r.audit, r.repaired_sha256[:8]) == (0, 0, "", "e3b0c442")
    chat = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], schema)
    more = chat
    for c in ("part", "seg", "pos", "copies", "fault", "digest", "at", "least", "__n", "__c", "__d", "k", "cost"):
        more = more.withColumn(c, F.lit("x"))
    assert _rows(repair.report(repair.repair(more), more)) == _rows(repair.report(repair.repair(chat), chat))
