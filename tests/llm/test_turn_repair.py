"""Conversation repair against a search over edits one turn at a time, and over all edits of short conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from emberwatch.llm import queries, turn_repair

LEGAL = re.compile("(s?(ua)+)?")
COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def damaged(rows):
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        out[conv_id]
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out[conv_id] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0], r[1], r[2])) for c, own in out.items()}


def faults(own):
    seen, out = set(), []
    for _, role, text in own:
        marks = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def viterbi(own, found):
    """Least (cost, audit, lines) over edits in order; `state` is the initial of the last turn given out."""
    after = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}
    names = {"u": "user", "a": "assistant"}

    def closed(best):
        while True:
            more = dict(best)
            for state, (cost, audit, lines) in best.items():
                for role in "ua":
                    if state in after[role]:
                        new = (cost + 2, audit + "I", (*lines, f"{names[role]}:"))
                        more[after[role][state]] = min(new, more.get(after[role][state], (10**9,)))
            if more == best:
                return best
            best = more

    best = closed({"": (0, "", ())})
    for (_, role, text), fault in zip(own, found):
        new = {}

        def offer(state, entry):
            new[state] = min(entry, new.get(state, (10**9,)))

        for state, (cost, audit, lines) in best.items():
            offer(state, (cost + 3, audit + "D", lines))
            if fault in ("b", "d"):
                continue
            more = cost + (fault == "t")
            if state in after.get(role[:1], {}):
                offer(after[role[:1]][state], (more, audit + "K", (*lines, f"{role}:{text}")))
            for r in "ua":
                if state in after[r]:
                    offer(after[r][state], (more + 2, audit + "R", (*lines, f"{names[r]}:{text}")))
        best = closed(new)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    out = {}
    for conv_id, own in damaged(rows).items():
        found = faults(own)
        cost, audit, lines = viterbi(own, found)
        turns = [t for t, *_ in own if t is not None]
        initials = [role[:1] for _, role, _ in own]
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(found.count(x) for x in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(frame):
    rows = frame.select(*COLUMNS).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("length", [0, 1, 2, 3, 4])
def test_parsing_against_all_edits(length):
    """Every choice of edits with up to two insertions at each place, tried on random short conversations."""
    draw = random.Random(length)
    gaps = ["", "I", "II"]
    for _ in range(12):
        symbols = "".join(draw.choice("suaoSUAOx") for _ in range(length))
        best = None
        for edits in itertools.product("KRD", repeat=length):
            if any(s == "x" and e != "D" for s, e in zip(symbols, edits)):
                continue
            for holes in itertools.product(gaps, repeat=length + 1):
                audit = holes[0] + "".join(e + h for e, h in zip(edits, holes[1:]))
                state, turn, cost = "", 0, 0
                for e in audit:
                    if e == "D":
                        cost += 3
                    elif e == "K":
                        state += symbols[turn].lower()
                    else:
                        state += "a" if state[-1:] == "u" else "u"
                        cost += 2
                    cost += e in "KR" and symbols[turn].isupper()
                    turn += e != "I"
                if LEGAL.fullmatch(state):
                    best = min(best or (cost, audit), (cost, audit))
        if symbols:
            assert turn_repair.least(turn_repair.span_cells(symbols)) == best


def test_any_split_gives_the_same_cells():
    draw = random.Random(7)
    for _ in range(60):
        symbols = "".join(draw.choice("suaUAox") for _ in range(draw.randint(2, 40)))
        at = draw.randint(1, len(symbols) - 1)
        both = turn_repair.combined(turn_repair.span_cells(symbols[:at]), turn_repair.span_cells(symbols[at:]))
        assert both == turn_repair.span_cells(symbols)


def test_op11_whole_answer(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got(queries.op11_turn_repair(spark, folder)) == expected(rows)


@pytest.mark.parametrize("span", [512, 4])
def test_edge_cases(spark, span, monkeypatch):
    """Nulls in every column, ties, repeated rows, a conversation with most rows (in one span or in many), one that
    loses all its rows, other roles, clashing columns, an empty table."""
    monkeypatch.setattr(turn_repair, "SPAN", span)
    monkeypatch.setattr(turn_repair, "FAN", 3)
    draw = random.Random(3)
    texts = [None, "", " \n", "Yes.", "no", "Why?\n", "Größe!", "a.b "]
    roles = [None, "", "user", "assistant", "system", "tool", "student"]
    rows = [(draw.choice([None, 1, 2, 3]), draw.choice([None, *range(9)]), draw.choice(roles), draw.choice(texts)) for _ in range(80)]
    rows += [(50, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(300)]
    rows += [(51, 0, "user", "Same.")] * 40 + [(52, 0, "system", "Only this.")]
    gone = next(c for c in range(100, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "lost.")]
    full = [(*r, 7, "x", -3, None) for r in rows]
    table = spark.createDataFrame(
        full, "conv_id long, turn long, role string, text string, fate int, copy string, place long, own long"
    )
    found = got(turn_repair.repair_report(table))
    assert found == expected(rows)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(turn_repair.repair_report(table.limit(0))) == {}


def test_repaired_turns_are_legal(spark, folder):
    rows = turn_repair.ordered(turn_repair.damaged(spark.read.parquet(f"{folder}/conversations.parquet")))
    parsed = turn_repair.parse(turn_repair.faults(rows))
    turns = defaultdict(dict)
    for r in turn_repair.repaired(rows, parsed).collect():
        turns[r["conv_id"]][r["nth"]] = r
    for own in turns.values():
        assert sorted(own) == list(range(len(own)))
        assert LEGAL.fullmatch("".join(own[i]["role"][0] for i in range(len(own))))
        assert all(r["text"] == "" for r in own.values() if r["edit"] == "I")
