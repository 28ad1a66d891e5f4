"""Tables and their foreign keys as a graph: load layers, order, cycles, reachability. Metadata-sized, on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from ..model import ConfigurationError, ForeignKey, Schema, TableRef


@dataclass(frozen=True)
class Graph:
    parents: dict[TableRef, frozenset[TableRef]]

    @property
    def children(self) -> dict[TableRef, set[TableRef]]:
        out: dict[TableRef, set[TableRef]] = {t: set() for t in self.parents}
        for child, ps in self.parents.items():
            for p in ps:
                out[p].add(child)
        return out

    def _groups(self) -> list[frozenset[TableRef]]:
        """Strongly connected components: tables that reach each other."""
        reach = {t: self._reach(t, self.parents) for t in self.parents}
        out, seen = [], set()
        for t in sorted(self.parents, key=lambda t: t.name):
            if t not in seen:
                group = frozenset({t, *(x for x in reach[t] if t in reach[x])})
                seen |= group
                out.append(group)
        return out

    @staticmethod
    def _reach(start: TableRef, edges) -> set[TableRef]:
        seen: set[TableRef] = set()
        todo = list(edges[start])
        while todo:
            t = todo.pop()
            if t not in seen:
                seen.add(t)
                todo += edges[t]
        return seen

    def load_layers(self) -> list[list[TableRef]]:
        """Parents before children; a cycle is in one layer, and what depends on it in a later one."""
        groups = self._groups()
        of = {t: g for g in groups for t in g}
        depth: dict[frozenset, int] = {}

        def deep(g) -> int:
            if g not in depth:
                depth[g] = 1 + max((deep(of[p]) for t in g for p in self.parents[t] if of[p] != g), default=-1)
            return depth[g]

        layers: dict[int, list[TableRef]] = {}
        for g in groups:
            layers.setdefault(deep(g), []).extend(g)
        return [sorted(layers[d], key=lambda t: t.name) for d in sorted(layers)]

    def load_order(self) -> list[TableRef]:
        return [t for layer in self.load_layers() for t in layer]

    def cycles(self) -> list[frozenset[TableRef]]:
        return [g for g in self._groups() if len(g) > 1]

    def dependents(self, t: TableRef) -> set[TableRef]:
        """All tables that need t; t itself only if it lies on a cycle."""
        return self._reach(t, self.children) if t in self.parents else set()


def build_graph(schema: Schema, virtual: tuple[ForeignKey, ...] = ()) -> Graph:
    """Keys of a table to itself don't order it."""
    parents: dict[TableRef, set[TableRef]] = {t.ref: set() for t in schema.tables}
    for fk in (*schema.foreign_keys, *virtual):
        for end in (fk.child, fk.parent):
            parents.setdefault(end, set())
        if fk.child != fk.parent:
            parents[fk.child].add(fk.parent)
    return Graph({t: frozenset(p) for t, p in parents.items()})


@dataclass(frozen=True)
class CycleRule:
    """How the tables of a cycle load: DEFERRED (together) or DECLARED_ORDER."""

    tables: tuple[str, ...]
    strategy: str
    load_order: tuple[str, ...] = ()


def resolve_cycle(cycle: frozenset[TableRef], rules: tuple[CycleRule, ...], deferred_capable: bool) -> tuple[str, list[TableRef]]:
    """(UNSUPPORTED, []), (DEFERRED, tables) or (DECLARED_ORDER, tables in order)."""
    names = {t.table.lower(): t for t in cycle}
    rule = next((r for r in rules if {x.lower() for x in r.tables} == names.keys()), None)
    if rule is None:
        return "UNSUPPORTED", []
    if rule.strategy == "DEFERRED":
        if not deferred_capable:
            raise ConfigurationError("the destination can't defer constraints")
        return "DEFERRED", sorted(cycle, key=lambda t: t.name)
    if rule.strategy != "DECLARED_ORDER":
        raise ConfigurationError(f"unknown cycle strategy {rule.strategy}")
    order = [x.lower() for x in rule.load_order]
    if sorted(order) != sorted(names):
        raise ConfigurationError("a declared order names every table of its cycle once")
    return "DECLARED_ORDER", [names[x] for x in order]
