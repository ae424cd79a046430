"""Memoised parsing with derivatives over token streams.

A grammar is a set of regular right parts whose only recursion goes through brackets (``grp``). A state
is what may still follow: for each bracket level a vector of regular right parts, each one the
derivative of a body by the tokens read at that level. Reading a token takes the derivative of the
innermost vector; an opener pushes the derivatives' continuations, a closer needs a nullable body and
pops. Nodes are interned, so equal derivatives are one object, and each (state, token) is derived once
per process: reading a token costs one dictionary look-up afterwards.

An empty derivative marks the exact failing token; a derivative that is not nullable at the end, or a
level still open, is a truncation.
"""

from __future__ import annotations

EMPTY, EPS = 0, 1


class Arena:
    """Interned regular right parts with memoised derivatives. Node ids are small integers."""

    def __init__(self):
        self.kind: list[tuple] = [("empty",), ("eps",)]
        self.null: list[bool] = [False, True]
        self.ids: dict[tuple, int] = {("empty",): 0, ("eps",): 1}
        self._d: dict[tuple[int, int], int] = {}
        self._o: dict[tuple[int, int], tuple] = {}

    def _node(self, key: tuple, null: bool) -> int:
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.kind)
            self.kind.append(key)
            self.null.append(null)
        return got

    def tok(self, classes) -> int:
        classes = frozenset(classes)
        return self._node(("tok", classes), False) if classes else EMPTY

    def grp(self, opener: int, body: str, closer: int) -> int:
        return self._node(("grp", opener, body, closer), False)

    def cat2(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPS:
            return b
        if b == EPS:
            return a
        key = self.kind[a]
        if key[0] == "cat":
            return self.cat2(key[1], self.cat2(key[2], b))
        return self._node(("cat", a, b), self.null[a] and self.null[b])

    def cat(self, *parts: int) -> int:
        got = EPS
        for p in reversed(parts):
            got = self.cat2(p, got)
        return got

    def alt(self, *parts: int) -> int:
        flat, toks = set(), set()
        for p in parts:
            key = self.kind[p]
            for q in key[1] if key[0] == "alt" else (p,):
                if q != EMPTY:
                    inner = self.kind[q]
                    if inner[0] == "tok":
                        toks |= inner[1]
                    else:
                        flat.add(q)
        if toks:
            flat.add(self.tok(toks))
        if not flat:
            return EMPTY
        if len(flat) == 1:
            return next(iter(flat))
        if EPS in flat and any(self.null[q] for q in flat if q != EPS):
            flat.discard(EPS)
            if len(flat) == 1:
                return next(iter(flat))
        return self._node(("alt", frozenset(flat)), any(self.null[q] for q in flat))

    def opt(self, *parts: int) -> int:
        return self.alt(EPS, self.cat(*parts))

    def star(self, *parts: int) -> int:
        a = self.cat(*parts)
        if a in (EMPTY, EPS):
            return EPS
        return a if self.kind[a][0] == "star" else self._node(("star", a), True)

    def plus(self, *parts: int) -> int:
        a = self.cat(*parts)
        return self.cat(a, self.star(a))

    def seplist(self, item: int, sep: int, trailing: bool = True) -> int:
        tail = self.star(sep, item)
        return self.cat(item, tail, self.opt(sep)) if trailing else self.cat(item, tail)

    def deriv(self, node: int, t: int) -> int:
        got = self._d.get((node, t))
        if got is not None:
            return got
        key = self.kind[node]
        op = key[0]
        if op == "tok":
            got = EPS if t in key[1] else EMPTY
        elif op == "cat":
            got = self.cat2(self.deriv(key[1], t), key[2])
            if self.null[key[1]]:
                got = self.alt(got, self.deriv(key[2], t))
        elif op == "alt":
            got = self.alt(*(self.deriv(q, t) for q in key[1]))
        elif op == "star":
            got = self.cat2(self.deriv(key[1], t), node)
        else:
            got = EMPTY
        self._d[node, t] = got
        return got

    def opened(self, node: int, t: int) -> tuple:
        """Pairs (body, closer, continuation) of the brackets that opener t may begin here."""
        got = self._o.get((node, t))
        if got is not None:
            return got
        key = self.kind[node]
        op = key[0]
        out: list[tuple] = []
        if op == "grp":
            out = [(key[2], key[3], EPS)] if key[1] == t else []
        elif op == "cat":
            out = [(b, c, self.cat2(k, key[2])) for b, c, k in self.opened(key[1], t)]
            if self.null[key[1]]:
                out += self.opened(key[2], t)
        elif op == "alt":
            out = [x for q in key[1] for x in self.opened(q, t)]
        elif op == "star":
            out = [(b, c, self.cat2(k, node)) for b, c, k in self.opened(key[1], t)]
        got = self._o[node, t] = tuple(dict.fromkeys(out))
        return got


class Machine:
    """The memoised derivative automaton of a grammar.

    names: token classes, a class being its index; openers and closers among them. semi: the class that
    may be inserted before an offending token that follows a line break, before a closer, or at the end
    (automatic semicolon insertion), else None.
    """

    def __init__(self, names: list[str], openers: list[str], closers: list[str], semi: str | None = None, semi_before: str = ""):
        self.arena = Arena()
        self.names, self.index = names, {n: i for i, n in enumerate(names)}
        self.open = frozenset(self.index[x] for x in openers)
        self.close = frozenset(self.index[x] for x in closers)
        self.semi = None if semi is None else self.index[semi]
        self.semi_before = frozenset(self.index[x] for x in semi_before.split())
        self.bodies: dict[str, int] = {}
        self.vectors: list[tuple[tuple[int, ...], bool]] = []
        self.vector_ids: dict[tuple, int] = {}
        self.step: list[dict[int, int]] = []
        self.frames: list[tuple] = []
        self.frame_ids: dict[tuple, int] = {}
        self.down: list[dict[int, tuple[int, int]]] = []
        self.up: dict[tuple[int, int, int], int] = {}

    # grammar notation -------------------------------------------------------------------------
    def t(self, *names: str) -> int:
        return self.arena.tok(self.index[n] for x in names for n in x.split())

    def g(self, opener: str, body: str, closer: str) -> int:
        return self.arena.grp(self.index[opener], body, self.index[closer])

    # states -----------------------------------------------------------------------------------
    def _vector(self, nodes: tuple[int, ...], after_break: bool = False) -> int:
        key = (nodes, after_break)
        got = self.vector_ids.get(key)
        if got is None:
            got = self.vector_ids[key] = len(self.vectors)
            self.vectors.append(key)
            self.step.append({})
            self.down.append({})
        return got

    def start(self, body: str) -> int:
        return self._vector((self.bodies[body],))

    def broke(self, s: int) -> int:
        """The state after a line break, where a semicolon may be inserted."""
        return self._vector(self.vectors[s][0], True)

    def read(self, s: int, t: int) -> int:
        """The state after a plain token, -1 if its derivative is empty."""
        nodes, after_break = self.vectors[s]
        d = self.arena.deriv
        got = tuple(d(n, t) for n in nodes)
        if not any(got) and self.semi is not None and (after_break or t in self.semi_before):
            got = tuple(d(d(n, self.semi), t) for n in nodes)
        r = self._vector(got) if any(got) else -1
        self.step[s][t] = r
        return r

    def enter(self, s: int, t: int) -> tuple[int, int]:
        """(state inside, frame) after an opener, (-1, -1) if none may begin here."""
        nodes, after_break = self.vectors[s]
        for insert in (False, True):
            found: dict[tuple[str, int], dict[int, int]] = {}
            for j, n in enumerate(nodes):
                n = self.arena.deriv(n, self.semi) if insert else n
                for body, closer, cont in self.arena.opened(n, t):
                    at = found.setdefault((body, closer), {})
                    at[j] = self.arena.alt(at.get(j, EMPTY), cont)
            if found or self.semi is None or not after_break:
                break
        if not found:
            r = (-1, -1)
        else:
            inner = self._vector(tuple(self.bodies[b] for b, _ in found))
            frame = (len(nodes), tuple((closer, tuple(sorted(k.items()))) for (_, closer), k in found.items()))
            f = self.frame_ids.get(frame)
            if f is None:
                f = self.frame_ids[frame] = len(self.frames)
                self.frames.append(frame)
            r = (inner, f)
        self.down[s][t] = r
        return r

    def leave(self, s: int, f: int, t: int) -> int:
        """The outer state after a closer, -1 if no body can end here."""
        nodes, _ = self.vectors[s]
        size, conts = self.frames[f]
        outer = [EMPTY] * size
        for insert in (False, True):
            for n, (closer, to) in zip(nodes, conts):
                n = self.arena.deriv(n, self.semi) if insert else n
                if closer == t and self.arena.null[n]:
                    for j, k in to:
                        outer[j] = self.arena.alt(outer[j], k)
            if any(outer) or self.semi is None:
                break
        r = self._vector(tuple(outer)) if any(outer) else -1
        self.up[s, f, t] = r
        return r

    def accepts(self, s: int) -> bool:
        nodes, _ = self.vectors[s]
        null = self.arena.null
        return any(null[n] or (self.semi is not None and null[self.arena.deriv(n, self.semi)]) for n in nodes)

    def run(self, tokens, start: int, skip: int, brk: int) -> int:
        """-1 for a valid stream, -2 for one that ends too early, else the index of the failing token.

        skip: class of tokens without meaning; brk: class of line breaks (may equal skip).
        """
        s, stack, step, down, up = start, [], self.step, self.down, self.up
        openers, closers = self.open, self.close
        i = -1
        for i, t in enumerate(tokens):
            n = step[s].get(t)
            if n is None:
                if t == skip:
                    step[s][t] = n = s
                elif t == brk:
                    n = self.broke(s)
                    step[s][t] = n
                elif t in openers:
                    n, f = down[s].get(t) or self.enter(s, t)
                    if n < 0:
                        return i
                    stack.append((s, f))
                elif t in closers:
                    if not stack:
                        return i
                    _, f = stack.pop()
                    n = up.get((s, f, t))
                    if n is None:
                        n = self.leave(s, f, t)
                    if n < 0:
                        return i
                else:
                    n = self.read(s, t)
            if n < 0:
                return i
            s = n
        return -2 if stack or not self.accepts(s) else -1
