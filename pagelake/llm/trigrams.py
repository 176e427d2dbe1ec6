"""Boolean trigram queries from regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

try:
    from re import _constants as C
    from re import _parser as P
except ImportError:  # Python < 3.11
    import sre_constants as C
    import sre_parse as P

#: Strings that a part of an expression may stand for before it is told by its trigrams alone.
EXACT = 32
#: Characters of a class that counts as its single characters.
CLASS = 4


@dataclass(frozen=True)
class Query:
    """all: every part holds; any: one part holds; gram: the text has the trigram. all of nothing is true."""

    kind: str
    parts: tuple[Query, ...] = ()
    gram: str = ""

    def grams(self) -> set[str]:
        return {self.gram} if self.kind == "gram" else set().union(*(p.grams() for p in self.parts))

    def lead(self) -> set[str]:
        """Trigrams of which a text that satisfies the query holds one: few, and those with other characters than letters first."""
        if self.kind == "gram":
            return {self.gram}
        if self.kind == "any":
            return set().union(*(p.lead() for p in self.parts))
        found = [p.lead() for p in self.parts]
        return min(found, key=lambda x: (len(x), sum(c.isalpha() for g in x for c in g)), default=set())

    def holds(self, grams: set[str]) -> bool:
        if self.kind == "gram":
            return self.gram in grams
        return (all if self.kind == "all" else any)(p.holds(grams) for p in self.parts)


TRUE = Query("all")


def conjunction(*parts: Query) -> Query:
    flat = list(dict.fromkeys(q for p in parts for q in (p.parts if p.kind == "all" else (p,))))
    return flat[0] if len(flat) == 1 else Query("all", tuple(flat))


def disjunction(parts: list[Query]) -> Query:
    flat = list(dict.fromkeys(parts))
    if TRUE in flat:
        return TRUE
    # what needs all that another part needs, and more, adds nothing
    needs = [set(p.parts) if p.kind == "all" else {p} for p in flat]
    flat = [p for p, n in zip(flat, needs, strict=True) if not any(m < n for m in needs)]
    if len(flat) == 1:
        return flat[0]
    # what all parts need stands once before them
    common = [q for q in (flat[0].parts if flat[0].kind == "all" else (flat[0],)) if all(q in (p.parts if p.kind == "all" else (p,)) for p in flat)]
    if common:
        rest = [Query("all", tuple(q for q in p.parts if q not in common)) for p in flat]
        return conjunction(*common, disjunction(rest))
    return Query("any", tuple(flat))


def of_strings(strings: set[str]) -> Query:
    """One of the strings occurs."""
    return disjunction([conjunction(*(Query("gram", gram=s[i : i + 3]) for i in range(len(s) - 2))) for s in sorted(strings)])


def thin(q: Query) -> Query:
    """Of many trigrams that are all needed the first and the last: those between are nearly always held with them."""
    if q.kind == "gram":
        return q
    if q.kind == "any":
        return disjunction([thin(p) for p in q.parts])
    grams = [p for p in q.parts if p.kind == "gram"]
    return conjunction(*(p if p.kind == "gram" else thin(p) for p in q.parts if p.kind != "gram" or p in (grams[0], grams[-1])))


def derive(pattern: str) -> Query:
    """What every lower-cased text with a match of the pattern satisfies; TRUE if nothing is mandatory."""

    def exact(op, arg) -> set[str] | None:
        """The strings that an item stands for, if they are few."""
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN and arg[0][0] is not C.NEGATE:
            chars: set[str] = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is C.RANGE and x[1] - x[0] < CLASS:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= CLASS else None
        if op is C.SUBPATTERN:
            return strings(arg[3])
        if op is C.BRANCH:
            found = [strings(b) for b in arg[1]]
            return set().union(*found) if all(f is not None for f in found) else None
        if op is C.MAX_REPEAT and (arg[0], arg[1]) in ((0, 1), (1, 1)):
            inner = strings(arg[2])
            return inner if inner is None or arg[0] else inner | {""}
        if op is C.AT:
            return {""}
        return None

    def strings(items) -> set[str] | None:
        now = {""}
        for op, arg in items:
            found = exact(op, arg)
            if found is None or len(found) * len(now) > EXACT:
                return None
            now = {a + b for a in now for b in found}
        return now

    def query(items) -> Query:
        parts, run = [], {""}
        for op, arg in items:
            found = exact(op, arg)
            if found is not None and len(found) * len(run) <= EXACT:
                run = {a + b for a in run for b in found}
                continue
            parts.append(of_strings(run))
            run = {""}
            if found is not None and len(found) <= EXACT:
                run = found
            elif op is C.SUBPATTERN:
                parts.append(query(arg[3]))
            elif op is C.BRANCH:
                parts.append(disjunction([query(b) for b in arg[1]]))
            elif op is C.MAX_REPEAT and arg[0] >= 1:
                parts.append(query(arg[2]))
        return conjunction(*parts, of_strings(run))

    return thin(query(P.parse(pattern, re.ASCII)))
