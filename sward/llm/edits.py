"""Cheapest edits that give a conversation a legal order of roles, by search from both ends.

The lattice has a node for each number of rows read and each state of the pattern ``(s?(ua)+)?`` of
role initials.  Keeping a row costs nothing, giving it the role the state asks for 1, deleting it 2,
inserting an empty row 5; an undeleted truncated row costs 5 more, blank and repeated rows must go.
Two searches, from the first node and from the last ones, take the cheapest open node each in turn;
once they meet they go on until no crossing of the same cost can be missed, and of all crossings of
least cost the one with the least audit (the initials of its edits, in ASCII order) is taken.
"""

import heapq

#: States: nothing read, after a system row, after a user row, after an answer.  Legal ends: the first and last.
NEW, SYSTEM, USER, DONE = range(4)
STATES, ENDS = 4, (NEW, DONE)
#: State after the user or assistant row that each state asks for, and that row's role.
NEXT = (USER, USER, DONE, USER)
ASKED = ("user", "user", "assistant", "user")
#: Kinds of rows beside their initial: to be deleted, truncated, sound.
DELETE, CUT, SOUND = range(3)
NEVER = float("inf")


def _moves(initial, kind):
    """``(from, to, cost, letter)`` of the edits that read a row."""
    out = [(q, q, 2, "D") for q in range(STATES)]
    if kind != DELETE:
        more = 5 if kind == CUT else 0
        for q in range(STATES):
            if initial == "s" and q == NEW:
                out.append((q, SYSTEM, more, "K"))
            if initial == ASKED[q][0]:
                out.append((q, NEXT[q], more, "K"))
            else:
                out.append((q, NEXT[q], 1 + more, "R"))
    return out


def _by(moves, side):
    out = [[] for _ in range(STATES)]
    for move in moves:
        out[move[side]].append((move[1 - side], *move[2:]))
    return out


_AHEAD, _BACK = {}, {}
for _initial in "sua ":
    for _kind in (DELETE, CUT, SOUND):
        _AHEAD[_initial, _kind] = _by(_moves(_initial, _kind), 0)
        _BACK[_initial, _kind] = _by(_moves(_initial, _kind), 1)
_INSERT = [(q, NEXT[q], 5, "I") for q in range(STATES)]
_INSERT_AHEAD, _INSERT_BACK = _by(_INSERT, 0), _by(_INSERT, 1)


def row_key(role, kind):
    """What the lattice needs to know of a row."""
    return role[:1] if role[:1] in ("s", "u", "a") else " ", kind


def cheapest(rows, start=NEW, goals=ENDS, inserts_at_end=True):
    """``(cost, audit, goal)`` from ``start`` before the first of ``rows`` to one of ``goals`` after the last.

    ``rows``: the ``row_key`` of each.  No way: an infinite cost.
    """
    n = len(rows)
    ahead, back = {start: (0, "")}, {n * STATES + q: (0, "", q) for q in goals}
    heap_a, heap_b = [(0, 0, start)], [(0, 0, node) for node in back]
    heapq.heapify(heap_b)
    done_a, done_b, best = set(), set(), NEVER

    def edges_ahead(node):
        i, q = divmod(node, STATES)
        if i < n:
            for to, cost, letter in _AHEAD[rows[i]][q]:
                yield node + STATES + to - q, cost, letter
        if i < n or inserts_at_end:
            for to, cost, letter in _INSERT_AHEAD[q]:
                yield node + to - q, cost, letter

    def edges_back(node):
        i, q = divmod(node, STATES)
        if i:
            for origin, cost, letter in _BACK[rows[i - 1]][q]:
                yield node - STATES + origin - q, cost, letter
        if i < n or inserts_at_end:
            for origin, cost, letter in _INSERT_BACK[q]:
                yield node + origin - q, cost, letter

    # Of equal costs the node nearer to its own end goes first: edges without cost always read a row,
    # so an audit is final when its node is taken.
    while heap_a and heap_b and heap_a[0][0] + heap_b[0][0] <= best:
        if heap_a[0][0] <= heap_b[0][0]:
            cost, _, node = heapq.heappop(heap_a)
            if node in done_a:
                continue
            done_a.add(node)
            audit = ahead[node][1]
            if node in back:
                best = min(best, cost + back[node][0])
            for to, more, letter in edges_ahead(node):
                label, old = (cost + more, audit + letter), ahead.get(to)
                if old is None or label < old:
                    ahead[to] = label
                    if old is None or label[0] < old[0]:
                        heapq.heappush(heap_a, (label[0], to // STATES, to))
                    if to in back:
                        best = min(best, label[0] + back[to][0])
        else:
            cost, _, node = heapq.heappop(heap_b)
            if node in done_b:
                continue
            done_b.add(node)
            _, audit, goal = back[node]
            if node in ahead:
                best = min(best, cost + ahead[node][0])
            for to, more, letter in edges_back(node):
                label, old = (cost + more, letter + audit, goal), back.get(to)
                if old is None or label < old:
                    back[to] = label
                    if old is None or label[0] < old[0]:
                        heapq.heappush(heap_b, (label[0], n - to // STATES, to))
                    if to in ahead:
                        best = min(best, label[0] + ahead[to][0])
    crossings = [(ahead[v][0], ahead[v][1], back[v][2]) for v in done_a if v // STATES == n and v % STATES in goals]
    for node in done_a:
        cost, audit = ahead[node]
        for to, more, letter in edges_ahead(node):
            if to in done_b and cost + more + back[to][0] == best:
                crossings.append((best, audit + letter + back[to][1], back[to][2]))
    return min((c for c in crossings if c[0] == best), default=(NEVER, "", None))


def apply(audit, roles, texts, state=NEW):
    """Roles and texts after the edits of ``audit``, from ``state`` on."""
    out_roles, out_texts, i = [], [], 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        system = letter == "K" and state == NEW and roles[i][:1] == "s"
        out_roles.append(roles[i] if letter == "K" else ASKED[state])
        out_texts.append("" if letter == "I" else texts[i])
        i += letter != "I"
        state = SYSTEM if system else NEXT[state]
    return out_roles, out_texts
