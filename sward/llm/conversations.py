"""Repair of the structure of conversations: faults of rows and the cheapest edits.

Rows are dealt by ranges of conversation and turn, so a conversation of any size is spread over tasks.
A task cuts its rows into pieces of bounded size.  A piece that is a whole conversation is settled at
once.  Of a conversation in several pieces, repeated rows are found by digests, each piece tells the
cheapest cost from each state to each other, the pieces of a conversation are chained over these few
numbers, and then each piece is edited between the states that the chain goes through.
"""

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from sward.llm.edits import CUT, DELETE, ENDS, NEVER, NEW, SOUND, STATES, apply, cheapest, row_key
from sward.session import cut_lineage

#: Rows and characters of text of a piece, one row at least.
ROWS, SIZE = 1024, 4 << 20
_BLANK = " \t\n\x0b\x0c\r"
PIECES = "conv_id long, part int, seq int, whole boolean, turns array<long>, roles array<string>, texts array<string>"
TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
SETTLED = f"conv_id long, {TOTALS}, audit string, roles array<string>, texts array<string>"
REPAIRED = f"no int, pieces int, {SETTLED}"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
          "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _batch(rows, schema):
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def damage(conversations):
    """The rows of ``conversations`` with the faults of a test, and ``gone`` for those it drops.

    ``crc32("conv_id:turn") % 20`` decides: 0 drops a row, 1 empties its text, 2 removes its sentence
    ends, 3 repeats it, 4 makes it the user's.  Nulls count as one space, in the key too.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("fault"),
    )
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") == 0).alias("gone"), F.explode(copies).alias("copy"),
    ).drop("copy")


def _cut(batches):
    """Sorted rows to pieces."""
    part, seq, first, conv, size, rows, opened = TaskContext.get().partitionId(), 0, True, None, 0, [], True

    def piece(closed):
        kept = [r for r in rows if not r[4]]
        return _batch([(conv, part, seq, closed and not opened, [r[1] for r in kept], [r[2] for r in kept], [r[3] for r in kept])], PIECES)

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if not first and row[0] != conv:
                yield piece(True)
                seq, size, rows, opened = seq + 1, 0, [], False
            elif rows and (len(rows) >= ROWS or size + len(row[3]) > SIZE):
                yield piece(False)
                seq, size, rows, opened = seq + 1, 0, [], True
            first, conv = False, row[0]
            size += len(row[3])
            rows.append(row)
    if not first:
        yield piece(False)


def _kinds(roles, texts, repeated):
    """Kind of each row for the lattice, and the counts of blank, repeated and truncated rows."""
    kinds, counts = [], [0, 0, 0]
    for i, text in enumerate(texts):
        end = text.rstrip(_BLANK)
        fault = 0 if not end else 1 if repeated[i] else 2 if end[-1] not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        kinds.append(row_key(roles[i], SOUND if fault is None else CUT if fault == 2 else DELETE))
    return kinds, counts


def _illegal(roles):
    return sum((a[:1], b[:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(roles, roles[1:]))


def _gaps(turns):
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


def _settle(batches):
    """Pieces that are whole conversations, repaired."""
    for batch in batches:
        for row in batch.to_pylist():
            roles, texts, seen = row["roles"], row["texts"], set()
            repeated = []
            for pair in zip(roles, texts):
                repeated.append(pair in seen)
                seen.add(pair)
            kinds, (blank, duplicate, truncated) = _kinds(roles, texts, repeated)
            cost, audit, _ = cheapest(kinds)
            fixed = apply(audit, roles, texts)
            yield _batch([(row["conv_id"], _gaps(row["turns"]), blank, duplicate, truncated, _illegal(roles), cost, audit, *fixed)], SETTLED)


# Costs and, for each first state, the order of the audits; then the costs where the piece is the last.
WAYS = (
    "conv_id long, part int, seq int, costs array<int>, ranks array<int>, last array<int>, "
    "blank long, duplicate long, truncated long, illegal long, n long, first string, final string, "
    "low long, high long, distinct long"
)
CHOSEN = f"part int, seq int, no int, pieces int, state int, goal int, {TOTALS}"
_NONE = 1 << 30


def _marked(row):
    again = set(row["again"] or [])
    return [i in again for i in range(len(row["roles"]))]


def _ways(batches):
    """Pieces of split conversations to what a chain needs to know of them."""
    for batch in batches:
        for row in batch.to_pylist():
            roles, turns = row["roles"], [t for t in row["turns"] if t is not None]
            kinds, counts = _kinds(roles, row["texts"], _marked(row))
            costs, ranks, last = [], [], []
            for q in range(STATES):
                found = [cheapest(kinds, q, (goal,), inserts_at_end=False) for goal in range(STATES)]
                costs += [_NONE if c == NEVER else c for c, _, _ in found]
                order = sorted(range(STATES), key=lambda goal: found[goal][1])
                ranks += [order.index(goal) for goal in range(STATES)]
                last.append(cheapest(kinds, q)[0])
            ends = (roles[0], roles[-1]) if roles else (None, None)
            spread = (min(turns), max(turns), len(set(turns))) if turns else (None, None, 0)
            yield _batch([(row["conv_id"], row["part"], row["seq"], costs, ranks, last, *counts, _illegal(roles), len(roles), *ends, *spread)], WAYS)


def _chain(pieces):
    """``CHOSEN`` rows of the pieces of one conversation, in order.

    A label is a cost and the rank of its audit among the audits of all states.  All audits up to a
    piece's end read the same rows and end with one, so none begins another, and ranks compare them.
    """
    labels, back = {NEW: (0, 0)}, []
    for p in pieces[:-1]:
        reached = {}
        for goal in range(STATES):
            ways = [(cost + p["costs"][q * STATES + goal], rank, q) for q, (cost, rank) in labels.items() if p["costs"][q * STATES + goal] < _NONE]
            if ways:
                reached[goal] = min(ways)
        order = sorted(reached, key=lambda goal: (reached[goal][1], p["ranks"][reached[goal][2] * STATES + goal]))
        labels = {goal: (reached[goal][0], order.index(goal)) for goal in reached}
        back.append({goal: reached[goal][2] for goal in reached})
    total, _, state = min((cost + pieces[-1]["last"][q], rank, q) for q, (cost, rank) in labels.items())
    states = [state]
    for origin in reversed(back):
        states.append(origin[states[-1]])
    states = states[::-1]
    some = [p for p in pieces if p["n"]]
    illegal = sum(p["illegal"] for p in some) + sum(_illegal([a["final"], b["first"]]) for a, b in zip(some, some[1:]))
    timed = [p for p in pieces if p["low"] is not None]
    # Turns ascend, so two neighbours can share one turn only.
    distinct = sum(p["distinct"] for p in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
    gaps = timed[-1]["high"] - timed[0]["low"] + 1 - distinct if timed else 0
    totals = [gaps, *(sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated")), illegal, total]
    for no, p in enumerate(pieces):
        goal = states[no + 1] if no + 1 < len(pieces) else -1
        yield p["part"], p["seq"], no, len(pieces), states[no], goal, *totals


def _chains(batches):
    conv, pieces = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if pieces and row["conv_id"] != conv:
                yield _batch(list(_chain(pieces)), CHOSEN)
                pieces = []
            conv = row["conv_id"]
            pieces.append(row)
    if pieces:
        yield _batch(list(_chain(pieces)), CHOSEN)


def _edit(batches):
    for batch in batches:
        for row in batch.to_pylist():
            kinds, _ = _kinds(row["roles"], row["texts"], _marked(row))
            final = row["goal"] < 0
            _, audit, _ = cheapest(kinds, row["state"], ENDS if final else (row["goal"],), inserts_at_end=final)
            fixed = apply(audit, row["roles"], row["texts"], row["state"])
            totals = [row[f.split()[0]] for f in TOTALS.split(", ")]
            yield _batch([(row["no"], row["pieces"], row["conv_id"], *totals, audit, *fixed)], REPAIRED)


def repair(rows):
    """Repaired conversations, in pieces: faults of the whole, edits and rows of the piece.

    ``rows``: ``conv_id, turn, role, text`` without nulls in the last two, and ``gone`` for rows that
    only name their conversation.  A piece is a whole conversation unless that is very large; ``no``
    numbers the ``pieces`` of one.  ``audit`` has a letter per edit (Keep, Rerole, Delete, Insert).

    * Rows are taken by turn, nulls first; rows of equal turn by role and text.  A null ``conv_id`` is
      a conversation like any other; without rows it has zeros and an empty audit.
    * The first fault of a row counts: blank, repeated (role and text seen before), truncated.
    * Other columns are not read.  An empty table gives an empty result.
    """
    start = F.substring("text", 1, 64)  # bounds are chosen by the start of a text: they travel to the driver
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    picked = rows.select("conv_id", "turn", "role", "text", "gone")
    cut = picked.repartitionByRange(*order, start).sortWithinPartitions(*order, "text").mapInArrow(_cut, PIECES)
    pieces = cut_lineage(cut, compression="zstd")
    split = pieces.where(~F.col("whole"))
    digest = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.length("row.roles"), "row.roles", "row.texts"), 256)
    marks = split.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    marks = marks.select("part", "seq", "at", digest.alias("sha"))
    first = marks.groupBy("sha").agg(F.min(F.struct("part", "seq", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = marks.join(first, "sha").where(F.struct("part", "seq", "at") != F.col("first"))
    again = again.groupBy("part", "seq").agg(F.collect_list("at").alias("again"))
    marked = cut_lineage(split.join(again, ["part", "seq"], "left"), compression="zstd")
    ways = marked.mapInArrow(_ways, WAYS).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    edited = marked.join(ways.mapInArrow(_chains, CHOSEN), ["part", "seq"]).mapInArrow(_edit, REPAIRED)
    # Literals, so that a reader of split conversations alone does not run the whole ones.
    whole = pieces.where("whole").mapInArrow(_settle, SETTLED).select(F.lit(0).alias("no"), F.lit(1).alias("pieces"), "*")
    return whole.unionByName(edited)


def digests(repaired):
    """One row per conversation: its faults, whole ``audit`` and SHA-256 of ``role:text`` lines.

    Only conversations in several pieces are shuffled; their lines are digested as they stream by.
    """
    totals = [f.split()[0] for f in TOTALS.split(", ")]
    lines = F.transform(F.arrays_zip("roles", "texts"), lambda r: F.concat(r["roles"], F.lit(":"), r["texts"]))
    own = repaired.select("conv_id", "no", "pieces", *totals, "audit", lines.alias("lines"))
    one = own.where("pieces = 1").select("conv_id", *totals, "audit", F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256"))
    out = f"conv_id long, {TOTALS}, audit string, repaired_sha256 string"

    def run(batches):
        audits, digest, empty = [], hashlib.sha256(), True
        for batch in batches:
            for row in batch.to_pylist():
                audits.append(row["audit"])
                for line in row["lines"]:
                    digest.update(("" if empty else "\n").encode() + line.encode())
                    empty = False
                if row["no"] + 1 == row["pieces"]:
                    yield _batch([(row["conv_id"], *[row[t] for t in totals], "".join(audits), digest.hexdigest())], out)
                    audits, digest, empty = [], hashlib.sha256(), True

    several = own.where("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "no")
    return one.unionByName(several.mapInArrow(run, out))
