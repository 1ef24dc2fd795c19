"""Graph patterns over triples(subj, pred, obj): required, optional and alternative parts, as joins.

A pattern is a triple of strings; one that starts with ? is a variable, anything else a constant.
Each pattern is a filtered scan of the triples, whose constants reach the source as pushed filters;
patterns that share variables are joined on them, optional parts by left joins, alternatives as a
union. Catalyst chooses the join strategies; patterns without a variable in common are refused, as they would make
every pair of their rows.

    Group(("?p", "a", "family:Person"), ("?p", "rdfs:label", "?name"),
          optional=[Group(either=[Group(("?p", "a", "family:Male"), bind={"sex": "male"}),
                                  Group(("?p", "a", "family:Female"), bind={"sex": "female"})])])

Defined cases: triples are a set, repeated ones count once; triples with nulls match nothing; a variable of an
optional part that isn't matched is null, and so is one that an alternative doesn't have; such a variable may not join
with others, as null would have to match anything; a pattern of constants only keeps all solutions
or none; a variable twice in one pattern matches equal terms; an empty table gives no solutions; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLACES = ("subj", "pred", "obj")


@dataclass(frozen=True)
class Group:
    """Patterns that hold together. either: alternatives, one of which holds; optional: groups that may hold; bind: constants as further variables."""

    patterns: tuple = ()
    either: tuple = ()
    optional: tuple = ()
    bind: dict = field(default_factory=dict)

    def __init__(self, *patterns: tuple[str, str, str], either=(), optional=(), bind=None):
        object.__setattr__(self, "patterns", patterns)
        object.__setattr__(self, "either", tuple(either))
        object.__setattr__(self, "optional", tuple(optional))
        object.__setattr__(self, "bind", dict(bind or {}))


@dataclass(frozen=True)
class _Solutions:
    """Rows with a column for each variable, and the variables that no row lacks."""

    rows: DataFrame
    sure: frozenset

    @property
    def names(self) -> set:
        return set(self.rows.columns)


def _scan(triples: DataFrame, pattern: tuple[str, str, str]) -> _Solutions:
    at: dict[str, list[str]] = {}
    rows = triples
    for place, term in zip(_PLACES, pattern, strict=True):
        if term.startswith("?"):
            at.setdefault(term[1:], []).append(place)
        else:
            rows = rows.filter(F.col(place) == term)
    rows = rows.filter(reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in _PLACES]))
    for places in at.values():
        for other in places[1:]:
            rows = rows.filter(F.col(places[0]) == F.col(other))
    return _Solutions(rows.select(*[F.col(p[0]).alias(name) for name, p in at.items()]).distinct() if at else rows.limit(1).select(), frozenset(at))


def _shared(a: _Solutions, b: _Solutions) -> list[str]:
    both = a.names & b.names
    if unsure := both - (a.sure & b.sure):
        raise ValueError(f"variables that may be unbound can't join: {sorted(unsure)}")
    return sorted(both)


def _joined(a: _Solutions, b: _Solutions, how: str = "inner") -> _Solutions:
    on = _shared(a, b)
    if not on:
        raise ValueError(f"no variable in common: {sorted(a.names)} and {sorted(b.names)}")
    return _Solutions(a.rows.join(b.rows, on, how), a.sure if how == "left" else a.sure | b.sure)


def _union(parts: list[_Solutions]) -> _Solutions:
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [p.rows for p in parts])
    return _Solutions(rows, frozenset.intersection(*[p.sure for p in parts]))


def _solved(triples: DataFrame, group: Group) -> _Solutions:
    bound = [p for p in group.patterns if any(t.startswith("?") for t in p)]
    parts = [_scan(triples, p) for p in bound] + ([_union([_solved(triples, g) for g in group.either])] if group.either else [])
    if not parts:
        raise ValueError("a group needs a pattern with a variable, or alternatives")
    # The next part is one that shares a variable with those before it, in the order given.
    done, rest = parts[0], parts[1:]
    while rest:
        at = next((k for k, x in enumerate(rest) if done.names & x.names), 0)
        done = _joined(done, rest.pop(at))
    for p in group.patterns:
        if p not in bound and _scan(triples, p).rows.isEmpty():
            done = _Solutions(done.rows.limit(0), done.sure)
    for g in group.optional:
        done = _joined(done, _solved(triples, g), "left")
    if taken := done.names & set(group.bind):
        raise ValueError(f"bound twice: {sorted(taken)}")
    return _Solutions(done.rows.withColumns({k: F.lit(v) for k, v in group.bind.items()}), done.sure | frozenset(group.bind)) if group.bind else done


def solutions(triples: DataFrame, group: Group, *select: str) -> DataFrame:
    """One row for each solution, with the selected variables (all, if none is named) as columns; solutions repeat where they come about in several ways."""
    rows = _solved(triples.select(*_PLACES), group).rows
    return rows.select(*select) if select else rows
