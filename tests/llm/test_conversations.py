import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from oddsmith.llm import conversations as c

MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FAULTS = {c.CLEAN: "clean", c.BLANK: "blank", c.DUPLICATE: "duplicate", c.TRUNCATED_TURN: "truncated"}


def cheapest(turns):
    """(cost, least audit) by Dijkstra's search over (turn, state)."""
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(turns) and state in (0, 3):
            return cost, audit
        if (at, state) in seen:
            continue
        seen.add((at, state))
        for role in "ua":
            if (state, role) in MOVES:
                heapq.heappush(heap, (cost + 3, audit + "I", at, MOVES[state, role]))
        if at == len(turns):
            continue
        initial, fault = turns[at]
        heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
        if FAULTS[fault] in ("clean", "truncated"):
            own = 3 * (FAULTS[fault] == "truncated")
            for letter, role, price in (("K", initial, own), ("R", "u", own + 3), ("R", "a", own + 3)):
                if (state, role) in MOVES:
                    heapq.heappush(heap, (cost + price, audit + letter, at + 1, MOVES[state, role]))


def test_layers_against_search():
    random.seed(7)
    layers = c.Layers()
    for _ in range(4000):
        turns = [(random.choice(["s", "u", "u", "a", "a", "x", ""]), random.choice([c.CLEAN, c.CLEAN, *FAULTS])) for _ in range(random.randint(0, 14))]
        assert layers.repair(turns) == cheapest(turns), turns
    long = [("u", c.CLEAN), ("a", c.CLEAN)] * 50_000
    assert layers.repair(long) == (0, "K" * 100_000)


def brute(rows, damaged=True):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        own = by[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    found = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, turns = set(), []
        for _, role, text in own:
            words = re.findall("[^\x20\x09-\x0d]", text)
            fault = c.BLANK if not words else c.DUPLICATE if (role, text) in seen else c.CLEAN if words[-1] in ".!?" else c.TRUNCATED_TURN
            seen.add((role, text))
            turns.append((role[:1], fault))
        cost, audit = cheapest(turns)
        numbers = [t for t, _, _ in own if t is not None]
        lines, left, state = [], list(own), 0
        for letter in audit:
            _, role, text = (None, "", "") if letter == "I" else left.pop(0)
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if state == 2 else "user"
            state = MOVES[state, role[:1]]
            lines.append(f"{role}:{text}")
        found[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(sum(f == k for _, f in turns) for k in (c.BLANK, c.DUPLICATE, c.TRUNCATED_TURN)),
            sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


def odd_rows():
    random.seed(3)
    texts = ["Yes.", "No!", "so", "", None, "\t\n ", "é?", "a. b", "end.\x0b", " ", "long " * 50_000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = [(conv, turn, random.choice(roles[:3] * 3 + roles), random.choice(texts)) for conv in range(40) for turn in range(random.randint(1, 9))]
    rows += [(None, t, random.choice(roles), random.choice(texts)) for t in (None, None, 3, 3, 9)]
    rows += [(77, None, "user", "Hi.")] * 5 + [(78, 5, r, "Same.") for r in ("user", "assistant", "user", "user")]
    return rows


def test_digests_against_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df.selectExpr("*", "1 AS kind", "'x' AS digest", "2 AS fault", "'y' AS audit")
    for damaged, got in ((True, c.repair_digests(c.damage(clash))), (False, c.repair_digests(clash))):
        want = brute(rows, damaged)
        assert {r.conv_id: tuple(r[1:]) for r in got.collect()} == want
    assert c.repair_digests(c.damage(df.limit(0))).collect() == []


def test_repaired_turns(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want, got = brute(rows, damaged=False), defaultdict(list)
    for r in c.repaired_turns(df).collect():
        got[r.conv_id].append(r)
    for conv, digest in want.items():
        own = sorted(got[conv], key=lambda r: r.position)
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own)) and [r.position for r in own] == list(range(len(own)))
        assert "".join(r.edit for r in own) == digest[-2].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == digest[-1]
        assert all(r.text == "" and r.turn is None for r in own if r.edit == "I")


def test_conversation_with_all_rows_dropped(spark):
    gone = next(i for i in range(500) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in c.repair_digests(c.damage(df)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
