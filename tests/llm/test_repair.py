import binascii
import hashlib
import random
import re
from collections import defaultdict

from sitesift.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, hash) by dynamic programming over whole audits."""
    seen, items, n = set(), [], defaultdict(int)
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = ("blank" if not solid else "duplicate" if (role, text) in seen else
                 "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
        n[fault] += 1
        items.append((role, text, fault))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = None
    for role, text, fault in [(None, None, None), *reversed(items)]:
        now = {}
        for q, follow in NEXT.items():
            ways = []
            if best is None:
                ways += [(0, "")] if q in ("", "a") else []
            else:
                ways.append((best[q][0] + 4, "D" + best[q][1]))
                if fault not in ("blank", "duplicate"):
                    cut = 3 * (fault == "truncated")
                    if role[:1] == follow or (not q and role[:1] == "s"):
                        ways.append((best[role[:1]][0] + cut, "K" + best[role[:1]][1]))
                    ways.append((best[follow][0] + cut + 3, "R" + best[follow][1]))
            now[q] = min(ways, default=(10 ** 9, ""))
        for _ in range(3):
            now = {q: min(now[q], (now[NEXT[q]][0] + 3, "I" + now[NEXT[q]][1])) for q in NEXT}
        best = now
    cost, audit = best[""]
    out, q, left = [], "", iter(items)
    for letter in audit:
        role, text, _ = (FULL[NEXT[q]], "", "") if letter == "I" else next(left)
        if letter != "D":
            q = role[:1] if letter == "K" else NEXT[q]
            out.append((role if letter == "K" else FULL[q]) + ":" + text)
    return n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute(data):
    conversations = defaultdict(list)
    for conv, turn, role, text in data:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = binascii.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        conversations[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in conversations.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *cheapest([r[1:] for r in rows]))
    return out


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def conversations(r, n, longest):
    out = []
    for conv in range(n):
        turn = 0
        for _ in range(r.randrange(1, longest)):
            turn += r.choice([0, 1, 1, 1, 2])
            out.append((conv if conv % 17 else None, turn if r.random() < 0.95 else None,
                        r.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "u", None]),
                        r.choice(["Yes.", "no", "Why? ", " \t", "", "a b\n", "Ok!\n", None, f"t{r.random()}."])))
    return out


def test_against_brute_force(spark):
    data = conversations(random.Random(2), 300, 14)
    assert got(repair.repaired(spark.createDataFrame(data, SCHEMA).repartition(3))) == brute(data)


def test_segments_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 3)
    data = conversations(random.Random(3), 120, 30)
    assert got(repair.repaired(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 16)
    data = [(1, t, "user" if t % 3 else "assistant", f"t{t % 50}" + "."[t % 7 == 0:]) for t in range(2500)]
    data += [(2, 5, "user", "same.")] * 2000 + [(3, 0, "system", "Be kind."), (3, 1, "user", "Hi?")]
    assert got(repair.repaired(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repaired(none).collect() == []
    # All rows dropped: zeros, an empty audit and the hash of nothing.
    turn = next(t for t in range(200) if binascii.crc32(f"7:{t}".encode()) % 20 == 0)
    gone = spark.createDataFrame([(7, turn, "user", "Hi.", 1, 2)], SCHEMA + ", pos int, times int")
    assert got(repair.repaired(gone)) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    keep = next(t for t in range(200) if binascii.crc32(f"8:{t}".encode()) % 20 > 4)
    long = [(8, keep, "user", "é😀 " * 200_000 + ".")]
    assert got(repair.repaired(spark.createDataFrame(long, SCHEMA))) == brute(long)


def test_search_against_all_edits():
    """Every way through a segment, from every last role to every other, by IDA* and by listing audits."""
    r = random.Random(6)
    for _ in range(150):
        items = [(None, False, r.randrange(1, 3)) if r.random() < 0.2 else (r.choice("suat"), r.random() < 0.3, 1)
                 for _ in range(r.randrange(1, 5))]
        search = repair.Search(items, False)
        for end in range(4):
            failed = {}
            for start in range(4):
                ways = listed(items, 0, start, end)
                assert bool(ways) == repair.reach(search, start, end)
                if ways:
                    assert search.run(start, (end,), failed) == min(ways)


def listed(items, i, last, end, inserts=0):
    """(cost, audit) of every way with at most two inserts before a row."""
    if i == len(items):
        return [(0, "")] if last == end and not inserts else []
    initial, cut, times = items[i]
    follow = repair.FOLLOWS[last]
    steps = [(4 * times, "D" * times, last)]
    if initial is not None:
        role = {"s": 1, "u": 2, "a": 3}.get(initial)
        if role == follow or (role == 1 and last == 0):
            steps.append((3 * cut, "K", role))
        steps.append((3 + 3 * cut, "R", follow))
    out = [(c + x, a + y) for c, a, q in steps for x, y in listed(items, i + 1, q, end)]
    if inserts < 2:
        out += [(3 + x, "I" + y) for x, y in listed(items, i, follow, end, inserts + 1)]
    return out
