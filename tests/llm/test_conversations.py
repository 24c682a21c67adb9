"""Repair of conversations against a plain search over suffixes."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from linewave.llm.conversations import damaged, repaired_turns, repairs, repairs_of_damaged

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired rows) of one conversation's rows."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = faults_of(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(None)
    def best(i, last, inserted):
        """Least (cost, audit) of what follows, and the repaired rows; ``last`` is the initial before."""
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserted < 3:
            for initial, role in (("u", "user"), ("a", "assistant")):
                if (last, initial) in step:
                    c, a, out = best(i, initial, inserted + 1)
                    found.append((c + 3, "I" + a, ((role, ""), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, out = best(i + 1, last, 0)
            found.append((c + 4, "D" + a, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                for cost, edit, new in ((0, "K", role), (3, "R", "user"), (3, "R", "assistant")):
                    if (last, new[:1]) in step:
                        c, a, out = best(i + 1, new[:1], 0)
                        found.append((c + cost + more, edit + a, ((new, text), *out)))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    assert GRAMMAR.match("".join(r[0] for r, _ in out))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, out)


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def odd_rows(seed, n):
    rnd = random.Random(seed)
    text = lambda: rnd.choice(["Hi.", "Hi.", "what", "é!", "", " \t", None, "no end ", "Done?\n", "a" * 5000])
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rnd.choice([1, 2, 3, 5, 9, 30])):
            rows.append((conv, rnd.choice([None, *range(6)] * 3 + list(range(40))), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]), text()))
    return rows


def grouped(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_equals_the_plain_search(spark):
    rows = odd_rows(3, 150)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", initial string, cost int")
    got = {r.conv_id: tuple(r)[1:] for r in repairs(docs).collect()}
    want = {c: plain(own) for c, own in grouped(rows).items()}
    assert got == {c: (*w[:-1], digest(w[-1])) for c, w in want.items()}
    turns = {}
    for r in repaired_turns(docs).collect():
        turns.setdefault(r.conv_id, {})[r.place] = (r.role, r.text)
    assert {c: [own[i] for i in range(len(own))] for c, own in turns.items()} == {c: list(w[-1]) for c, w in want.items() if w[-1]}


def test_damage_and_conversations_that_lose_all_rows(spark):
    rows = odd_rows(4, 120)
    left = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    lost = next(i for i in range(10**6, 2 * 10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    docs = spark.createDataFrame([*rows, (lost, 0, "user", "Hi.")], SCHEMA)
    assert sorted(map(str, map(tuple, damaged(docs).collect()))) == sorted(map(str, left))
    own = grouped(left)
    want = {c: plain(own.get(c, [])) for c in {r[0] for r in rows} | {lost}}
    assert {r.conv_id: tuple(r)[1:] for r in repairs_of_damaged(docs).collect()} == {c: (*w[:-1], digest(w[-1])) for c, w in want.items()}
    assert want[lost][-2] == ""


def test_long_conversation_and_empty_table(spark):
    rnd = random.Random(9)
    rows = [(1, i, rnd.choice(["user", "assistant", "system"]), rnd.choice(["So it is.", f"So {i}", f"{i}!", ""])) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = plain([r[1:] for r in rows])
    assert [tuple(r)[1:] for r in repairs(docs).collect()] == [(*want[:-1], digest(want[-1]))]
    none = spark.createDataFrame([], SCHEMA)
    assert repairs(none).count() == repaired_turns(none).count() == repairs_of_damaged(none).count() == 0
