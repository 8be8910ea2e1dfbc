"""Bounded graph traversal: a few joins for a few hops, with caps that are part of the result."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.shared import written


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b).alias("a"), F.col(a).alias("b")))


def bounded_bfs(steps: DataFrame, roots: DataFrame, depth: int, cap: int = 200, budget: bool = False) -> DataFrame:
    """id, depth, truncated of what is reached over steps (a, b) within ``depth``; at most ``cap`` nodes by depth and id.

    A level keeps cap + 1 new nodes, so that a full cap shows as such; with ``budget`` it keeps what earlier levels
    have left of the cap. Levels are written, so a plan never holds more than one hop, and at most depth * (cap + 1)
    nodes are broadcast to meet the steps.
    """
    visited = frontier = written(roots.select("id", F.lit(0).alias("depth")), "level")
    saturated = False
    for d in range(1, depth + 1):
        room = max(0, cap - visited.count()) if budget else cap
        new = steps.join(F.broadcast(frontier.select(F.col("id").alias("a"))), "a", "left_semi").select(F.col("b").alias("id")).distinct().join(F.broadcast(visited.select("id")), "id", "left_anti")
        frontier = written(new.orderBy("id").limit(room + 1).withColumn("depth", F.lit(d)), "level")
        found = frontier.count()
        if budget and found > room:
            saturated = True
            frontier = written(frontier.orderBy("id").limit(room), "level")
        if not found:
            break
        visited = visited.unionByName(frontier)
    out = capped(visited, cap, "depth", "id")
    return out.withColumn("truncated", F.lit(True)) if saturated else out


def capped(df: DataFrame, cap: int, *order: str) -> DataFrame:
    """The first ``cap`` rows in order, and ``truncated``: whether there were more. The window holds cap + 1 rows at most."""
    w = Window.orderBy(*order)
    kept = df.orderBy(*order).limit(cap + 1).withColumn("_n", F.row_number().over(w)).withColumn("truncated", F.max("_n").over(Window.partitionBy()) > cap)
    return kept.where(F.col("_n") <= cap).drop("_n")


def inner_edges(edges: DataFrame, nodes: DataFrame, a: str, b: str) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("id").alias(a)), a, "left_semi").join(nodes.select(F.col("id").alias(b)), b, "left_semi")


def walks(steps: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """path (array) of every simple walk over steps (a, b) from start (id), the start alone too."""
    level = found = start.select(F.array("id").alias("path"))
    for _ in range(depth):
        level = level.join(steps, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path")).distinct()
        found = found.union(level)
    return found


def modularity_communities(edges: pd.DataFrame) -> pd.DataFrame:
    """Greedy modularity on one small edge list (columns a, b): the best merge until none gains; ties go to the smaller ids.

    Nodes are worked on by their place in order, so ids may be of any type that has one. Every community's degree sum and links to the others are kept up to date, so a round is a scan of the links.
    """
    names = sorted(set(edges["a"]) | set(edges["b"]))
    nth = {x: k for k, x in enumerate(names)}
    seen = {tuple(sorted((nth[a], nth[b]))) for a, b in edges[["a", "b"]].itertuples(index=False) if a != b}
    m = len(seen)
    degree: dict[int, int] = {}
    links: dict[int, dict[int, int]] = {}
    for a, b in seen:
        for x, y in ((a, b), (b, a)):
            degree[x] = degree.get(x, 0) + 1
            links.setdefault(x, {})[y] = 1
    members = {x: {x} for x in degree}
    while True:
        best = max(((c / m - degree[x] * degree[y] / (2 * m * m), -x, -y) for x in links for y, c in links[x].items() if x < y), default=None)
        if best is None or best[0] <= 1e-12:
            break
        x, y = -best[1], -best[2]
        members[x] |= members.pop(y)
        degree[x] += degree.pop(y)
        for z, c in links.pop(y).items():
            links[z].pop(y)
            if z != x:
                links[x][z] = links[x].get(z, 0) + c
                links[z][x] = links[x][z]
    return pd.DataFrame([(names[min(c)], names[x], len(c)) for c in members.values() for x in c], columns=["community", "node", "size"])


def cyclic_core(edges: DataFrame, group: str) -> DataFrame:
    """Edges (group, a, b) that can lie on a cycle: nodes without a way in or without a way out go, until none is left."""
    left = written(edges.select(group, "a", "b").where("a <> b").distinct(), "edges")
    n = left.count()
    while n:
        ins, outs = left.select(group, F.col("b").alias("a")).distinct(), left.select(group, F.col("a").alias("b")).distinct()
        left = written(left.join(ins, [group, "a"], "left_semi").join(outs, [group, "b"], "left_semi"), "edges")
        n, before = left.count(), n
        if n == before:
            break
    return left


def loops(edges: pd.DataFrame) -> list[tuple]:
    """The cycles that a depth-first walk closes, each as its sorted nodes. Nodes and steps are taken in order, so the same edges give the same cycles."""
    steps: dict = {}
    for a, b in sorted(set(zip(edges["a"].tolist(), edges["b"].tolist(), strict=True))):
        steps.setdefault(a, []).append(b)
    state: dict = {}
    found = set()
    for root in sorted(steps):
        if root in state:
            continue
        path, todo = [root], [iter(steps.get(root, ()))]
        state[root] = 1
        while todo:
            nxt = next(todo[-1], None)
            if nxt is None:
                todo.pop()
                state[path.pop()] = 2
            elif nxt not in state:
                state[nxt] = 1
                path.append(nxt)
                todo.append(iter(steps.get(nxt, ())))
            elif state[nxt] == 1:
                found.add(tuple(sorted(path[path.index(nxt) :])))
    return sorted(found)
