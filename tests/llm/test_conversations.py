import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sward.llm import conversations
from sward.llm.conversations import damage, digests, repair
from sward.llm.edits import CUT, DELETE, SOUND, apply, cheapest, row_key
from sward.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, GONE_ int, no string"
LEGAL = re.compile(r"(s?(ua)+)?")


def _all_audits(rows):
    """Cheapest and least of all audits, by trying every edit of every row and all insertions."""
    best = None
    inserts = range(len(rows) + 3)
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(e != "D" and kind == DELETE for e, (_, kind) in zip(edits, rows)):
            continue
        base = sum({"K": 0, "R": 1, "D": 2}[e] + (5 if e != "D" and kind == CUT else 0) for e, (_, kind) in zip(edits, rows))
        kept = [("ua" if e == "R" else initial) for e, (initial, _) in zip(edits, rows) if e != "D"]
        for extra in inserts:
            if best is not None and base + 5 * extra > best[0]:
                break
            for places in itertools.combinations_with_replacement(range(len(edits) + 1), extra):
                letters, roles, k = [], [], 0
                for i in range(len(edits) + 1):
                    n = places.count(i)
                    letters += ["I"] * n
                    roles += ["ua"] * n
                    if i < len(edits):
                        letters.append(edits[i])
                        if edits[i] != "D":
                            roles.append(kept[k])
                            k += 1
                if any(LEGAL.fullmatch("".join(c)) for c in itertools.product(*roles)):
                    found = (base + 5 * extra, "".join(letters))
                    best = found if best is None else min(best, found)
    return best


def test_cheapest_equals_all_ways():
    rng = random.Random(11)
    for _ in range(60):
        rows = [(rng.choice("suaua "), rng.choice([SOUND, SOUND, CUT, DELETE])) for _ in range(rng.randint(0, 4))]
        assert cheapest(rows)[:2] == _all_audits(rows)


def _table(rows):
    """Cheapest and least audit of long conversations, column by column."""
    asked, after = ["u", "u", "a", "u"], [2, 2, 3, 2]

    def settle(labels):
        for _ in range(3):
            for q in range(4):
                if q in labels:
                    new = (labels[q][0] + 5, labels[q][1] + "I")
                    labels[after[q]] = min(labels.get(after[q], new), new)
        return labels

    labels = settle({0: (0, "")})
    for initial, kind in rows:
        new = {}
        for q, (cost, audit) in labels.items():
            ways = [(q, cost + 2, "D")]
            if kind != DELETE:
                more = 5 if kind == CUT else 0
                ways.append((after[q], cost + more + (initial != asked[q]), "K" if initial == asked[q] else "R"))
                if q == 0 and initial == "s":
                    ways.append((1, cost + more, "K"))
            for to, c, letter in ways:
                new[to] = min(new.get(to, (c, audit + letter)), (c, audit + letter))
        labels = settle(new)
    return min(labels[q] for q in (0, 3) if q in labels)


def test_long_conversations_equal_a_table():
    rng = random.Random(12)
    for _ in range(60):
        rows = [(rng.choice("suaua "), rng.choice([SOUND, SOUND, SOUND, CUT, DELETE])) for _ in range(rng.randint(0, 60))]
        assert cheapest(rows)[:2] == _table(rows)


def _expected(rows):
    """The whole query row by row; ``rows`` are conv_id, turn, role, text."""
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept[conv]
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept[conv] += [(turn is not None, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, found in kept.items():
        found.sort(key=lambda r: (r[0], r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in found if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, counts, kinds = set(), Counter(), []
        for _, _, role, text in found:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            kinds.append(row_key(role, {"": SOUND, "t": CUT}.get(fault, DELETE)))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit = _table(kinds)
        roles, texts = apply(audit, [r[2] for r in found], [r[3] for r in found])
        assert LEGAL.fullmatch("".join(r[:1] for r in roles))
        lines = "\n".join(f"{r}:{t}" for r, t in zip(roles, texts))
        sha = hashlib.sha256(lines.encode()).hexdigest()
        out[conv] = (conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, sha)
    return set(out.values())


def _check(table):
    found = [tuple(r) for r in digests(repair(damage(table))).collect()]
    expected = _expected([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    assert len(found) == len(set(found)) and set(found) == expected


def test_query_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    expected = _expected([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    assert {tuple(r) for r in QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.001").collect()} == expected


def _random(rng, convs, rows):
    texts = ["Hello.", "Why?", "no end", "", " \t\n", None, "Yes!  ", "é.", "Hello.", "long " * 500 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    return [
        (rng.choice([*range(convs), None]), rng.choice([*range(rows), None]), rng.choice(roles), rng.choice(texts), 1, "x")
        for _ in range(convs * rows)
    ]


def test_edge_cases(spark):
    """Nulls everywhere, equal turns, repeated rows, blank texts, a conversation that loses all rows."""
    rng = random.Random(1)
    lost = next(i for i in range(1000) if zlib.crc32(f"{1000 + i}:0".encode()) % 20 == 0)
    rows = _random(rng, 12, 6) + [(1000 + lost, 0, "user", "Hi.", 1, "x")] + [(77, 5, "user", "Same.", 1, "x")] * 4
    table = spark.createDataFrame(rows, SCHEMA)
    _check(table)
    _check(table.coalesce(1))
    assert digests(repair(damage(table.where("false")))).count() == 0


@pytest.mark.parametrize("size", [1, 3, 40])
def test_pieces_do_not_matter(spark, size, monkeypatch):
    """Conversations cut into pieces, as a very large one is, by the same rules."""
    rng = random.Random(size)
    rows = [(conv, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B!", "c", "", f"{t}?"]), 1, "x")
            for conv in (1, 2) for t in range(45)]
    cut = conversations._cut
    monkeypatch.setattr(conversations, "_cut", _with_rows(cut, size))
    _check(spark.createDataFrame(rows + _random(rng, 4, 5), SCHEMA))


def _with_rows(cut, size):
    def run(batches):
        cut.__globals__["ROWS"] = size
        try:
            yield from cut(batches)
        finally:
            cut.__globals__["ROWS"] = 1024

    return run
