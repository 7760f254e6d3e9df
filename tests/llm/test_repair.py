import hashlib
import random
import re
import zlib

import pytest
from citeloom.llm import repair as r

SCHEMA = "conv_id long, turn long, role string, text string, CODE int, part string"
AFTER = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def least(items, entry, goals):
    """Shortest edits by dynamic programming; an item is (initial, truncated) or None, which has to go."""
    now = {entry: (0, "")}

    def with_inserts(now):
        now = dict(now)
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                more = (cost + 2, audit + "I")
                now[AFTER[state]] = min(now.get(AFTER[state], more), more)
        return now

    for item in items:
        then = {}
        for state, (cost, audit) in with_inserts(now).items():
            moves = [(state, (cost + 3, audit + "D"))]
            if item:
                initial, cut = item
                moves.append((AFTER[state], (cost + 2 + cut, audit + "R")))
                if (state, initial) in KEEP:
                    moves.append((KEEP[state, initial], (cost + cut, audit + "K")))
            for to, found in moves:
                then[to] = min(then.get(to, found), found)
        now = then
    return min(found for state, found in with_inserts(now).items() if state in goals)


def brute(rows):
    """Report and digest of each conversation, straight from the rules."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        convs.setdefault(conv, []).extend([(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(fate, 1))
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda x: (*x[:3], hashlib.sha256(x[3].encode()).digest()))
        turns = [t for known, t, _, _ in found if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts, seen, items = {"blank": 0, "again": 0, "cut": 0}, set(), []
        for _, _, role, text in found:
            bare = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "blank" if not bare else "again" if (role, text) in seen else "cut" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            items.append(None if fault in ("blank", "again") else (role[:1], fault == "cut"))
        initials = [role[:1] for _, _, role, _ in found]
        odd = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = least(items, 0, (0, 3))
        lines, state, at = [], 0, 0
        for edit in audit:
            role, text = found[at][2:] if edit != "I" else (None, "")
            at += edit != "I"
            if edit == "K":
                state = KEEP[state, role[0]]
            elif edit in "RI":
                state = AFTER[state]
                role = {2: "user", 3: "assistant"}[state]
            if edit != "D":
                lines.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["again"], counts["cut"], odd, cost, audit, digest)
    return out


def found(spark, rows, n=3):
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA).repartition(n)
    return {x.conv_id: tuple(x)[1:] for x in r._repaired(r.damaged(df)).mapInArrow(r.digests, r.DIGESTS).collect()}


def some_rows(draw, convs, turns):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "u", "", "aide"]
    texts = ["Hi there.", "What?", "well", "", None, " \t", "Ja! \n", "ok", "…", "No. "]
    return [
        (draw.choice(convs), draw.choice([None, *range(turns)]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.6 else f"text {draw.randrange(10**6)}.")
        for _ in range(len(convs) * turns)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_search_agrees_with_dynamic_programming(seed):
    draw = random.Random(seed)
    for _ in range(300):
        items = tuple(draw.choice([0, 1, 2, 3, 4, 5, 6, 1, 2, 1, 2, -1, -2]) for _ in range(draw.randrange(14)))
        plain = [x for i in items for x in ([None] * -i if i < 0 else [("suax"[i % 4], i >= 4)])]
        for entry in r.STATES:
            for goals in ((0, 3), (1,), (2,), (3,)):
                try:
                    wanted = least(plain, entry, goals)
                except ValueError:
                    wanted = None
                assert r.search(items, entry, goals) == wanted


def test_random_conversations(spark):
    rows = some_rows(random.Random(3), [None, -7, *range(120)], 9)
    assert found(spark, rows) == brute(rows)


def test_one_conversation_over_many_tasks(spark):
    """A conversation with most of the rows is dealt to several tasks and settled by its pieces' tables."""
    draw = random.Random(9)
    rows = [(5, i, "user" if i % 2 else "assistant", f"text {i}." if i % 7 else "same.") for i in range(1500)]
    rows += [(5, 700, "user", "all at once.")] * 40 + some_rows(draw, [1, 2, 9], 30)
    assert found(spark, rows, 6) == brute(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (2, 0, "user", " "), (3, 2, "user", "Why?"), (3, 4, "user", "How")]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA)
    turns = sorted(tuple(x) for x in r.repaired_turns(df).collect())
    assert turns == [
        (1, 1, "system", "Be kind."), (1, 2, "user", ""), (1, 3, "assistant", "Hello."),
        (3, 1, "user", "Why?"), (3, 2, "assistant", "How"),
    ]
    assert r.repaired_turns(df.filter("false")).collect() == []
    assert found(spark, []) == {}
