"""Cheapest repair of a list of turns: bidirectional Dijkstra over the edit lattice.

A node is (turns consumed, state); the states are those of the wanted
order of roles ``(s?(ua)+)?``: 0 nothing yet, 1 after system, 2 after
user, 3 after assistant.  Edges are edits: Keep, Rerole, Delete consume a
turn, Insert does not.  From one node each letter leads to one node only,
and equally dear paths to one node never extend one another.  So

* a reverse label needs no string: the least of its equally cheap first
  letters starts the least rest;
* a forward label is a tree of least paths; two paths are compared at
  the point where they part, found over jump pointers in O(log n).

A turn is ``(run, initial, truncated)``: ``run`` > 0 stands for that many
neighbouring turns that must be deleted, else it is 0.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heappop, heappush

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The state that a user or assistant turn leads to, and its role.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
_KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
FINAL = (0, 3)
_FAR = float("inf")


@lru_cache(10_000)
def moves(run: int, initial: str, truncated: bool) -> tuple:
    """Per state the edits of one turn: (letter, cost, next state)."""
    out = []
    for s in range(4):
        edits = [("D", DELETE * max(run, 1), s)]
        if not run:
            more = TRUNCATED * bool(truncated)
            to = _KEPT.get((initial, s)) if initial else s
            if to is not None:
                edits.append(("K", KEEP + more, to))
            edits.append(("R", REROLE + more, NEXT[s]))
        out.append(tuple(edits))
    return tuple(out)


class _Tree:
    """Forward labels: least paths from the source, as a growing tree."""

    def __init__(self, root):
        self.up, self.jump, self.depth, self.letter = {root: root}, {root: root}, {root: 0}, {root: ""}

    def add(self, v, parent, letter):
        self.up[v], self.letter[v], self.depth[v] = parent, letter, self.depth[parent] + 1
        j, d = self.jump[parent], self.depth
        self.jump[v] = self.jump[j] if d[parent] - d[j] == d[j] - d[self.jump[j]] else parent

    def _lift(self, v, depth):
        while self.depth[v] > depth:
            v = self.jump[v] if self.depth[self.jump[v]] >= depth else self.up[v]
        return v

    def less(self, p, a, q, b) -> bool:
        """Whether (path to p, then letter a) comes before (path to q, then b)."""
        dp, dq = self.depth[p], self.depth[q]
        if dp > dq:
            x = self._lift(p, dq + 1)
            if self.up[x] == q:
                return self.letter[x] < b
            p = self.up[x]
        elif dq > dp:
            x = self._lift(q, dp + 1)
            if self.up[x] == p:
                return a < self.letter[x]
            q = self.up[x]
        elif p == q:
            return a < b
        while self.up[p] != self.up[q]:
            if self.jump[p] != self.jump[q]:
                p, q = self.jump[p], self.jump[q]
            else:
                p, q = self.up[p], self.up[q]
        return self.letter[p] < self.letter[q]

    def path(self, v) -> list[str]:
        out = []
        while self.depth[v]:
            out.append(self.letter[v])
            v = self.up[v]
        return out[::-1]


@lru_cache(50_000)
def solve_short(turns: tuple, start: int = 0, finals: tuple = FINAL):
    return solve(turns, start, finals)


def solve(turns, start: int = 0, finals: tuple = FINAL):
    """(cost, letters) of the cheapest edits from state ``start`` to one of
    ``finals``, the ASCII-least among equally cheap ones; None if there is
    no way.  A ``run`` has one letter, its D."""
    n = len(turns)
    steps = [moves(*t) for t in turns]

    def succ(v):
        i, s = v
        yield "I", INSERT, (i, NEXT[s])
        if i < n:
            for letter, cost, to in steps[i][s]:
                yield letter, cost, (i + 1, to)

    def pred(v):
        i, s = v
        for p in range(4):
            if NEXT[p] == s:
                yield "I", INSERT, (i, p)
            if i:
                for letter, cost, to in steps[i - 1][p]:
                    if to == s:
                        yield letter, cost, (i - 1, p)

    src = (0, start)
    tree = _Tree(src)
    ahead, behind = {src: 0}, {(n, f): 0 for f in finals}
    came, goes = {}, {v: None for v in behind}
    done_f, done_r = set(), set()
    # equal costs leave the heaps in the direction of the search: free edits always consume a turn
    heap_f, heap_r = [(0, 0, start)], [(0, 0, f) for f in finals]
    best = _FAR
    while heap_f or heap_r:
        top_f, top_r = heap_f[0][0] if heap_f else _FAR, heap_r[0][0] if heap_r else _FAR
        if top_f + top_r > best or best == _FAR == min(top_f, top_r):
            break
        if top_f <= top_r:
            cost, i, s = heappop(heap_f)
            v = (i, s)
            if v in done_f or cost > ahead[v]:
                continue
            done_f.add(v)
            if v != src:
                tree.add(v, *came[v])
            if v in done_r:
                best = min(best, cost + behind[v])
            for letter, c, w in succ(v):
                new, old = cost + c, ahead.get(w, _FAR)
                if new < old:
                    ahead[w], came[w] = new, (v, letter)
                    heappush(heap_f, (new, *w))
                elif new == old and w not in done_f and tree.less(v, letter, *came[w]):
                    came[w] = (v, letter)
                if w in done_r:
                    best = min(best, new + behind[w])
        else:
            cost, i, s = heappop(heap_r)
            v = (n - i, s)
            if v in done_r or cost > behind[v]:
                continue
            done_r.add(v)
            if v in done_f:
                best = min(best, cost + ahead[v])
            for letter, c, w in pred(v):
                new, old = cost + c, behind.get(w, _FAR)
                if new < old:
                    behind[w], goes[w] = new, (letter, v)
                    heappush(heap_r, (new, n - w[0], w[1]))
                elif new == old and w not in done_r and goes[w] is not None and letter < goes[w][0]:
                    goes[w] = (letter, v)
                if w in done_f:
                    best = min(best, new + ahead[w])
    if best == _FAR:
        return None
    # every cheapest path has a last node in front of the first one that the forward search has not settled
    least = None
    for v in done_f:
        if ahead[v] > best:
            continue
        crossings = [(v, "", None)] if v[0] == n and v[1] in finals and ahead[v] == best else []
        crossings += [(v, letter, w) for letter, c, w in succ(v)
                      if w in done_r and w not in done_f and ahead[v] + c + behind[w] == best]
        for x in crossings:
            if least is None or tree.less(x[0], x[1], least[0], least[1]):
                least = x
    v, letter, w = least
    letters = tree.path(v)
    while w is not None:
        letters.append(letter)
        letter, w = goes[w] or ("", None)
    return best, "".join(letters)
