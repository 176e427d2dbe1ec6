"""SQL for arrays and texts of any length: what a plain fold or substring would do in quadratic time."""

from __future__ import annotations

#: Elements that one fold appends to an array.
RUN = 256
#: Code points of a block of text.
BLOCK = 4096


def let(value: str, name: str, body: str) -> str:
    """body, in which name stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def before(values: str, step: str = "{a} + {x}") -> str:
    """Of each element of an array<bigint> the fold (from 0) of all before it.

    Runs of RUN elements are folded apart, from the folds of all runs before; step is associative.
    """

    def fold(of: str, first: str) -> str:
        return f"aggregate({of}, struct({first} as a, cast(array() as array<bigint>) as o), (s, x) -> struct({step.format(a='s.a', x='x')} as a, concat(s.o, array(s.a)) as o)).o"

    run = f"slice(v, b * {RUN} + 1, {RUN})"
    tops = f"transform(runs, b -> aggregate({run}, 0L, (a, x) -> {step.format(a='a', x='x')}))"
    whole = f"flatten(transform(runs, b -> {fold(run, 'base[b]')}))"
    runs = f"if(size(v) > 0, sequence(0, (size(v) - 1) div {RUN}), cast(array() as array<int>))"
    return let(values, "v", let(runs, "runs", let(tops, "tops", let(fold("tops", "0L"), "base", whole))))


def blocks(text: str) -> str:
    """The text in blocks of BLOCK code points."""
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"


def cut(of: str, start: str, end: str) -> str:
    """Code points start to end of a text given as its blocks."""
    piece = f"substring({of}[k], greatest({start} - k * {BLOCK}, 0) + 1, least({end}, (k + 1) * {BLOCK}) - greatest({start}, k * {BLOCK}))"
    return f"if({end} <= {start}, '', array_join(transform(sequence(cast(({start}) div {BLOCK} as int), cast(({end} - 1) div {BLOCK} as int)), k -> {piece}), ''))"
