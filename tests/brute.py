"""Plain-Python restatement of the definitions, one name at a time, for small books."""

from __future__ import annotations

from collections import defaultdict
from decimal import Decimal


class Brute:
    def __init__(self, rows):
        self.parent = {e[0]: e[4] for e in rows["entities"]}
        self.rating = {e[0]: e[8] for e in rows["entities"]}
        self.loans = {n[0]: (n[2], int(n[3]), n[5] == "active") for n in rows["loans"]}
        self.lenders = {n[1] for n in rows["loans"]}
        self.guarantees = [(g[0], g[1], g[2], int(g[3])) for g in rows["guarantees"]]
        self.items = defaultdict(set)
        self.attrs = {}
        for c in rows["collateral"]:
            self.items[c[0]].add(c[3])
            self.attrs[c[0]] = (c[2], c[4], int(c[5]) if c[5] else None, int(c[6] or 0))
        self.limits = {x[1]: int(x[2]) for x in rows["limits"]}

    def walk(self, e):
        seen = []
        while e is not None and e not in seen:
            seen.append(e)
            e = self.parent.get(e)
        return seen, e

    def path(self, e):
        return self.walk(e)[0]

    def ubo(self, e):
        seen, again = self.walk(e)
        return again if again is not None else seen[-1]

    def heads(self):
        return [e for e, p in self.parent.items() if p is None and e not in self.lenders]

    def connected(self, head):
        inside = lambda e: head in self.path(e)
        active = {i: v for i, v in self.loans.items() if v[2]}
        direct = sum(a for b, a, _ in active.values() if inside(b))
        given = sum(
            a for _, by, n, a in self.guarantees if inside(by) and n in active and not inside(active[n][0])
        )
        outside = set()
        for members in self.items.values():
            live = [n for n in members if n in active]
            if any(inside(active[n][0]) for n in live):
                outside |= {n for n in live if not inside(active[n][0])}
        return direct, given, sum(active[n][1] for n in outside)

    def attributed(self):
        out = defaultdict(int)
        for n, (b, a, live) in self.loans.items():
            if live:
                owner = self.ubo(b)
                for _, by, m, _ in sorted(self.guarantees):
                    if m == n and self.ubo(by) != self.ubo(b):
                        owner = self.ubo(by)
                        break
                out[owner] += a
        return dict(out)

    def net(self, e):
        mine = {n for n, (b, _, live) in self.loans.items() if live and b == e}
        gross = sum(self.loans[n][1] for n in mine)
        value = sum(
            v[2] * (100 - v[3]) / 100
            for c, v in self.attrs.items()
            if v[2] is not None and self.items[c] <= mine
        )
        return max(0, gross - value)

    def group(self, head):
        return {e for e in self.parent if self.ubo(e) == head} | {head}

    def solvent(self, n, defaulted):
        return any(m == n and by not in defaulted for _, by, m, _ in self.guarantees)

    def cascade(self, head):
        d = self.group(head)
        active = {i: v for i, v in self.loans.items() if v[2]}
        direct = sum(0.45 * a for n, (b, a, _) in active.items() if b in d and not self.solvent(n, d))
        lost = {n for _, by, n, _ in self.guarantees if by in d and n in active and active[n][0] not in d}
        return direct, sum(0.45 * active[n][1] for n in lost)

    def multiround(self, head, cap=None):
        d = self.group(head)
        first = len(d)
        total = sum(v[2] or 0 for v in self.attrs.values()) or 1
        rounds, haircut = 0, 0.0
        while cap is None or rounds < cap:
            rounds += 1
            dumped = sum(v[2] or 0 for v in self.attrs.values() if v[0] in d)
            haircut = min(0.5, 0.5 * dumped / total)
            owed = defaultdict(int)
            for _, by, n, a in self.guarantees:
                if self.loans[n][0] in d and by not in d:
                    owed[by] += a
            new = set()
            for e, a in owed.items():
                if Decimal(a) > round(Decimal(0.3 * (1 - haircut)), 12) * Decimal(str(self.net(e))):
                    new |= self.group(e)
            if new <= d:
                break
            d |= new
        loss = sum(
            min(1.0, 0.45 + haircut) * a
            for n, (b, a, live) in self.loans.items()
            if live and b in d and not self.solvent(n, d)
        )
        return rounds, len(d), len(d) - first, loss, round(haircut, 3)
