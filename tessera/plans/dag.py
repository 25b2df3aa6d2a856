"""Preprocessing graph: JSON spec -> validated nodes -> one chained projection.

Spec format (as stored by users)::

    {"nodes": {"1": {"function": "add", "args": {"c1": "x1", "c2": "x3"}}, ...},
     "edges": [["1", "3"], ...]}

Node ids are normalised to strings (JSON keys are strings, edges may be
ints).  Unknown ids or functions, wrong arguments, missing columns and cycles
are rejected before any job runs.  Nodes run in topological order with
zero-indegree nodes taken last-in-first-out (the order the reference's graph
library yields, e.g. the example adds ``x5n, (x3)^2, x1+x3, (x1+x3)^2``).

Row-wise nodes become native expressions that Catalyst collapses into one
projection.  ``normalize`` divides by the column's L2 norm, a scalar subquery
over the same input; Catalyst merges all norm subqueries into one aggregate.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.columns import OPERATIONS, l2_norm, normalize_expr, q


class DagError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    id: str
    function: str
    args: tuple[tuple[str, str], ...]

    @property
    def kwargs(self) -> dict[str, str]:
        return dict(self.args)

    @property
    def output(self) -> str:
        return OPERATIONS[self.function].out_name(**self.kwargs)


@dataclass(frozen=True)
class DagSpec:
    nodes: dict[str, Node]
    edges: tuple[tuple[str, str], ...]

    def order(self) -> list[str]:
        return topological_order(list(self.nodes), self.edges)


def parse_spec(config) -> DagSpec:
    if isinstance(config, (str, bytes)):
        config = json.loads(config)
    if not isinstance(config, dict) or "nodes" not in config:
        raise DagError("spec needs a 'nodes' object")
    nodes: dict[str, Node] = {}
    for raw_id, body in config["nodes"].items():
        nid = str(raw_id)
        if nid in nodes:
            raise DagError(f"duplicate node id {nid!r}")
        fn = body.get("function")
        if fn not in OPERATIONS:
            raise DagError(f"node {nid}: unknown function {fn!r}; known: {sorted(OPERATIONS)}")
        args = body.get("args") or {}
        want = OPERATIONS[fn].args
        if set(args) != set(want):
            raise DagError(f"node {nid}: {fn} takes arguments {list(want)}, got {sorted(args)}")
        nodes[nid] = Node(nid, fn, tuple((k, str(args[k])) for k in want))
    edges = []
    for e in config.get("edges") or []:
        if len(e) != 2:
            raise DagError(f"edge {e!r} must have two ends")
        a, b = str(e[0]), str(e[1])
        for end in (a, b):
            if end not in nodes:
                raise DagError(f"edge {e!r} names unknown node {end!r}")
        edges.append((a, b))
    return DagSpec(nodes, tuple(edges))


def topological_order(node_ids: list[str], edges) -> list[str]:
    """Kahn's algorithm with a LIFO ready stack (nodes in insertion order)."""
    children: dict[str, list[str]] = {n: [] for n in node_ids}
    indeg = {n: 0 for n in node_ids}
    for a, b in edges:
        children[a].append(b)
        indeg[b] += 1
    ready = [n for n in node_ids if indeg[n] == 0]
    order = []
    while ready:
        n = ready.pop()
        order.append(n)
        for ch in children[n]:
            indeg[ch] -= 1
            if indeg[ch] == 0:
                ready.append(ch)
    if len(order) != len(node_ids):
        raise DagError("graph has a cycle: " + ", ".join(n for n in node_ids if n not in order))
    return order


def derived_columns(spec: DagSpec, input_columns: list[str]) -> list[tuple[str, Node]]:
    """Validate names along the order; returns (output name, node) once per name."""
    known = set(input_columns)
    made: dict[str, Node] = {}
    out = []
    for nid in spec.order():
        node = spec.nodes[nid]
        for _, col in node.args:
            if col not in known:
                raise DagError(f"node {nid}: column {col!r} does not exist at this point")
        name = node.output
        if name in made:
            prev = made[name]
            if (prev.function, prev.args) != (node.function, node.args):
                raise DagError(f"node {nid}: output {name!r} already made by a different node")
            continue
        if name in input_columns:
            raise DagError(f"node {nid}: output {name!r} collides with an input column")
        made[name] = node
        known.add(name)
        out.append((name, node))
    return out


def apply_dag(df: DataFrame, config, new_only: bool = False) -> DataFrame:
    """Append every derived column (in graph order) -- or, with
    ``new_only`` (P5), return just the derived columns."""
    spec = config if isinstance(config, DagSpec) else parse_spec(config)
    plan = derived_columns(spec, df.columns)
    current = df
    for name, node in plan:
        op = OPERATIONS[node.function]
        if op.needs_norm:
            (c,) = [v for _, v in node.args]
            norm = current.select(l2_norm(c)).scalar()
            expr = normalize_expr(c, norm)
        else:
            expr = op.expr(**node.kwargs)
        current = current.withColumn(name, expr)
    if new_only:
        return current.select(*[q(name) for name, _ in plan])
    return current


def apply_node(df: DataFrame, function: str, **args) -> DataFrame:
    """A single operation, e.g. ``apply_node(df, 'log', c='x1')``."""
    return apply_dag(df, {"nodes": {"1": {"function": function, "args": args}}, "edges": []})


def rowwise_only(config) -> bool:
    """True when no node needs an aggregate (usable on a streaming frame)."""
    spec = config if isinstance(config, DagSpec) else parse_spec(config)
    return not any(OPERATIONS[n.function].needs_norm for n in spec.nodes.values())

