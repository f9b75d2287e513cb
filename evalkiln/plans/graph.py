"""A typed graph of nodes on the driver: validation, topological order and parallel levels."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from evalkiln.checks import GraphValidation

#: Nodes of a graph whose levels are found; edges may be any number.
SMALL_GRAPH = 100_000

#: The kinds of nodes.
NODE_KINDS = frozenset(
    "transform y_transform split model fork map feature_join prediction_join mixed_join source_join tag exclude augmentation adapter aggregator generator restructure tuner subgraph chart".split()
)


@dataclass(frozen=True)
class Node:
    id: str
    kind: str = "transform"


@dataclass(frozen=True)
class Edge:
    src: str
    dst: str
    carries: str = "data"  #: data or prediction
    requires_oof: bool = False


@dataclass
class Graph:
    nodes: dict[str, Node] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)

    @classmethod
    def of(cls, nodes: list[tuple[str, str]] = (), edges: list = ()) -> Graph:
        made = [e if isinstance(e, Edge) else Edge(*e) for e in edges]
        kinds = {n: "transform" for e in made for n in (e.src, e.dst)} | dict(nodes)
        out = cls({n: Node(n, k) for n, k in kinds.items()}, made)
        out.validate()
        return out

    def validate(self) -> None:
        for n in self.nodes.values():
            if n.kind not in NODE_KINDS:
                raise GraphValidation(f"no such node kind: {n.kind}")
        for e in self.edges:
            if e.src not in self.nodes or e.dst not in self.nodes:
                raise GraphValidation(f"edge to an unknown node: {e}")
            if e.requires_oof and e.carries != "prediction":
                raise GraphValidation(f"out-of-fold is for prediction edges only: {e}")
        self.levels()

    def levels(self) -> list[list[str]]:
        """Nodes by the length of the longest path to them, each level sorted by id."""
        into: dict[str, int] = {n: 0 for n in self.nodes}
        out: dict[str, list[str]] = defaultdict(list)
        for e in self.edges:
            into[e.dst] += 1
            out[e.src].append(e.dst)
        now, found, seen = sorted(n for n, k in into.items() if not k), [], 0
        while now:
            found.append(now)
            seen += len(now)
            after = []
            for n in now:
                for m in out[n]:
                    into[m] -= 1
                    if not into[m]:
                        after.append(m)
            now = sorted(after)
        if seen < len(self.nodes):
            raise GraphValidation("the graph has a cycle")
        return found

    def order(self) -> list[str]:
        return [n for level in self.levels() for n in level]

    def active(self, wanted: set[str]) -> set[str]:
        """Wanted nodes and all they depend on."""
        before = defaultdict(set)
        for e in self.edges:
            before[e.dst].add(e.src)
        todo, seen = list(wanted), set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo.extend(before[n])
        return seen


def levels(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, level) of a graph given as a table (src, dst): the length of the longest path that ends at the node.

    Each round lifts every node above its predecessors; nodes without any are level 0. A cycle never comes to rest and is
    refused once there are more rounds than nodes.
    """
    edges = edges.select("src", "dst").distinct()
    found = {r[0]: 0 for r in edges.select("src").union(edges.select("dst")).distinct().limit(SMALL_GRAPH + 1).collect()}
    n, spark = len(found), edges.sparkSession
    if n > SMALL_GRAPH:
        raise GraphValidation(f"a graph of more than {SMALL_GRAPH} nodes")
    for _ in range(min(rounds, n) + 1):
        table = spark.createDataFrame(list(found.items()), "node string, level int")
        lifted = edges.join(F.broadcast(table), F.col("src") == F.col("node")).groupBy("dst").agg((F.max("level") + 1).alias("level"))
        after = found | {r.dst: max(found[r.dst], r.level) for r in lifted.collect()}
        if after == found:
            return table
        found = after
    raise GraphValidation("the graph has a cycle")
