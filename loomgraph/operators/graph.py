"""Graph operators over edge tables (src, dst): degrees, betweenness, cut nodes, communities, impact, views.

Loops write each round to the shared folder, so plans stay short and a lost executor costs one round. Traversal, paths and
PageRank are in ``traverse``, cycles in ``strong``, communities of large components in ``louvain``.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship
from ..storage import written
from .components import components
from .louvain import louvain
from .strong import cycles, strong_components  # noqa: F401
from .traverse import bfs, closure, pagerank, shortest_path  # noqa: F401


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree of every node; zero where it has no edge."""
    one = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    count = one.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("id").join(count, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each undirected component."""
    found = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return nodes.select("id").join(found.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def _dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, b): the sum of all sources' dependencies on each node, by levels of all searches at once.

    Forward, rows (s, v) carry the number of shortest paths; backward, each level takes its share of the next. A level is a
    shuffle of its rows and is written, so no node's edges and no search meet in one task.
    """
    edges = written(edges.select("src", "dst").where("src <> dst").distinct())
    front = seen = written(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("c")))
    levels = [front]
    while True:
        step = edges.join(front, F.col("src") == F.col("v")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("c").alias("c"))
        front = written(step.join(seen.select("s", "v"), ["s", "v"], "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.union(front)
    after, total = levels[-1].withColumn("x", F.lit(0.0)), None
    for level in levels[-2:0:-1]:
        near = edges.join(after.select("s", F.col("v").alias("dst"), F.col("c").alias("d"), "x"), "dst").select("s", F.col("src").alias("v"), "d", "x")
        share = near.join(level, ["s", "v"]).groupBy("s", "v").agg(F.sum(F.col("c") / F.col("d") * (1 + F.col("x"))).alias("x"))
        after = written(level.join(share, ["s", "v"], "left").select("s", "v", "c", F.coalesce("x", F.lit(0.0)).alias("x")))
        total = after if total is None else total.union(after)
    total = levels[0].limit(0).withColumn("x", F.lit(0.0)) if total is None else total
    return total.groupBy(F.col("v").alias("id")).agg(F.sum("x").alias("b"))


def betweenness(nodes: DataFrame, edges: DataFrame, most_sources: int | None = None, sampled: int = 200, most_edges: int = 2_000_000) -> DataFrame:
    """(id, betweenness) after Brandes, directed, normalised, from all sources; with ``most_sources`` and more nodes, from ``sampled`` of smallest hash.

    Up to ``most_edges`` edges each source is one independent search over two broadcast arrays, as many at a time as the
    session has shuffle partitions; beyond them all sources advance together in joins.
    """
    ship(nodes.sparkSession)
    n = nodes.count()
    sources, scale = nodes.select("id"), 1.0
    if most_sources is not None and n > most_sources:
        sources, scale = sources.orderBy(F.xxhash64("id")).limit(sampled), n / sampled
    norm = scale / max(1, (n - 1) * (n - 2))
    ranked = lambda parts: nodes.select("id").join(parts, "id", "left").select("id", F.coalesce(F.col("b") * norm, F.lit(0.0)).alias("betweenness"))
    if edges.limit(most_edges + 1).count() > most_edges:
        return ranked(_dependencies(edges, sources))
    pairs = edges.select("src", "dst").where("src <> dst").distinct().toArrow()
    names, ends = np.unique(np.concatenate([pairs.column(c).to_numpy(zero_copy_only=False).astype(object) for c in ("src", "dst")] or [[]]), return_inverse=True)
    begin, end = np.split(ends, 2)
    by = np.lexsort((end, begin))
    spark = nodes.sparkSession
    sent = spark.sparkContext.broadcast((names, np.searchsorted(begin[by], np.arange(len(names) + 1)), end[by].astype(np.int32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, first, to = sent.value
        total = np.zeros(len(names))
        for batch in batches:
            at = np.searchsorted(names, batch["id"].to_numpy(dtype=object))
            for s, name in zip(at, batch["id"]):
                if s < len(names) and names[s] == name:  # else it has no edges
                    total += _shares(first, to, s)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": pd.Series(names[some], dtype=object), "b": total[some]})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranked(sources.repartition(tasks).mapInPandas(run, "id string, b double").groupBy("id").agg(F.sum("b").alias("b")))


def _shares(first: np.ndarray, to: np.ndarray, source: int) -> np.ndarray:
    """Each node's dependency of one source: shortest paths counted a level at a time, then shared out backwards."""
    n = len(first) - 1
    dist, paths = np.full(n, -1, np.int32), np.zeros(n)
    dist[source], paths[source] = 0, 1.0
    level, steps = np.array([source]), []
    while len(level):
        many = first[level + 1] - first[level]
        a = np.repeat(level, many)
        b = to[np.repeat(first[level] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
        new = np.unique(b[dist[b] < 0])
        dist[new] = len(steps) + 1
        on = dist[b] == len(steps) + 1
        a, b = a[on], b[on]
        paths += np.bincount(b, paths[a], minlength=n)
        steps.append((a, b))
        level = new
    share = np.zeros(n)
    for a, b in reversed(steps):
        share += np.bincount(a, paths[a] / paths[b] * (1 + share[b]), minlength=n)
    share[source] = 0.0
    return share


def _cut_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    near = defaultdict(list)
    for a, b in sorted(zip(pdf["a"], pdf["b"])):
        near[a].append(b)
        near[b].append(a)
    seen, low, cut, clock = {}, {}, set(), 0
    for root in sorted(near):
        if root in seen:
            continue
        seen[root] = low[root] = clock = clock + 1
        stack, children = [(root, None, iter(near[root]))], 0
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w not in seen:
                    seen[w] = low[w] = clock = clock + 1
                    stack.append((w, v, iter(near[w])))
                    break
                if w != parent:
                    low[v] = min(low[v], seen[w])
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[v])
                    if up == root:
                        children += 1
                    elif low[v] >= seen[up]:
                        cut.add(up)
        if children > 1:
            cut.add(root)
    return pd.DataFrame({"id": pd.Series(sorted(cut), dtype=object)})


def _levels(pairs: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """(id, parent, level) of breadth-first trees from ``roots`` (id) over pairs in both directions, and the deepest level."""
    seen = frontier = written(roots.select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level")))
    level = 0
    while True:
        step = pairs.join(frontier.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        frontier = written(step.join(seen.select("id"), "id", "left_anti").select("id", "parent", F.lit(level + 1).alias("level")))
        if frontier.isEmpty():
            return written(seen), level
        seen, level = seen.union(frontier), level + 1


def _upwards(tree: DataFrame, deepest: int, values: DataFrame, fold: dict[str, object]) -> DataFrame:
    """(id, *values) with each node's values folded with those of all below it, a level at a time from the deepest."""
    names = list(fold)
    rows = tree.join(values, "id")
    done = None
    below = None
    for level in range(deepest, -1, -1):
        here = rows.where(F.col("level") == level).select("id", "parent", *names)
        if below is not None:
            up = below.where("parent is not null").select(F.col("parent").alias("id"), *names)
            both = here.select("id", *names).union(up).groupBy("id").agg(*[f(c).alias(c) for c, f in fold.items()])
            here = here.select("id", "parent").join(both, "id")
        below = written(here.select("id", "parent", *names))
        done = below if done is None else done.union(below)
    return done.select("id", *names)


def _cut_wide(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of cut nodes by blocks of tree edges (Tarjan and Vishkin, 1985), for components of any size.

    Over a breadth-first tree: preorder numbers from subtree sizes, the least and greatest number that a subtree reaches by
    other edges, and components of the tree edges that lie on a common cycle. A node with edges of two blocks is a cut
    node. Rounds grow with the tree's depth; no component meets in one task.
    """
    both = written(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    tree, deepest = _levels(both, roots)
    size = written(_upwards(tree, deepest, tree.select("id", F.lit(1).cast("long").alias("size")), {"size": F.sum}))
    before = F.coalesce(F.sum("size").over(W.partitionBy("parent").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    step = written(tree.join(size, "id").withColumn("step", F.when(F.col("parent").isNull(), F.lit(0)).otherwise(1 + before)))
    at = pre = written(step.where("level = 0").select("id", "step", F.col("step").alias("pre")))
    for level in range(1, deepest + 1):
        here = step.where(F.col("level") == level).select("id", "parent", "step").join(at.select(F.col("id").alias("parent"), "pre"), "parent")
        at = written(here.select("id", "step", (F.col("pre") + F.col("step")).alias("pre")))
        pre = pre.union(at)
    num = written(tree.join(size, "id").join(pre.select("id", "pre"), "id"))
    of = num.select("id", "parent", "pre")
    ends = both.join(of.toDF("a", "pa", "na"), "a").join(of.toDF("b", "pb", "nb"), "b")
    other = written(ends.where("not (pa <=> b) and not (pb <=> a)").select("a", "b", "nb"))
    own = num.select("id", "pre").join(other.groupBy(F.col("a").alias("id")).agg(F.min("nb").alias("lo"), F.max("nb").alias("hi")), "id", "left")
    own = own.select("id", F.least("pre", "lo").alias("lo"), F.greatest("pre", "hi").alias("hi"))
    reach = _upwards(tree, deepest, own, {"lo": F.min, "hi": F.max})
    up = num.select(F.col("id").alias("parent"), F.col("parent").alias("above"), F.col("pre").alias("p"), F.col("size").alias("s"))
    child = num.where("parent is not null").select("id", "parent").join(reach, "id").join(up, "parent")
    on_cycle = child.where("above is not null and (lo < p or hi >= p + s)").select(F.col("id").alias("u"), F.col("parent").alias("v"))
    blocks = components(other.select(F.col("a").alias("u"), F.col("b").alias("v")).union(on_cycle))
    block = written(num.where("parent is not null").select("id", "parent").join(blocks.withColumnRenamed("u", "id"), "id", "left").select("id", "parent", F.coalesce("root", "id").alias("block")))
    touch = block.select("id", "block").union(block.select(F.col("parent").alias("id"), "block"))
    return touch.groupBy("id").agg(F.countDistinct("block").alias("n")).where("n > 1").select("id")


def articulation_points(nodes: DataFrame, edges: DataFrame, most: int = 200_000) -> DataFrame:
    """(id) whose removal splits its component.

    Components of at most ``most`` edges are searched depth first, one in a task; larger ones by ``_cut_wide``. Both are exact.
    """
    ship(nodes.sparkSession)
    part = written(connected(nodes, edges))
    both = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    pairs = written(both.join(part, F.col("a") == F.col("id")).select("component", "a", "b"))
    sizes = pairs.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    wide = written(sizes.where(F.col("n") > most).select("component"))
    found = pairs.join(wide, "component", "left_anti").groupBy("component").applyInPandas(_cut_nodes, "id string")
    if wide.isEmpty():
        return found
    return found.union(_cut_wide(pairs.join(wide, "component", "left_semi"), wide.select(F.col("component").alias("id"))))


def _greedy(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(zip(pdf["a"], pdf["b"]))
        names = sorted({x for p in pairs for x in p})
        if len(names) <= 4 or len(names) > most:
            return pd.DataFrame({"id": names, "community": names[0]})
        m = len(pairs)
        group = {x: {x} for x in names}
        weight: dict[str, dict[str, float]] = {x: defaultdict(float) for x in names}
        for a, b in pairs:
            weight[a][b] += 1
            weight[b][a] += 1
        degree = {x: sum(weight[x].values()) for x in names}
        while len(group) > 1:
            gain, a, b = max(((w / m - degree[x] * degree[y] / (2 * m * m), x, y) for x in group for y, w in weight[x].items() if x < y), default=(0, "", ""))
            if gain <= 0:
                break
            group[a] |= group.pop(b)
            degree[a] += degree.pop(b)
            for y, w in weight.pop(b).items():
                del weight[y][b]
                if y != a:
                    weight[a][y] += w
                    weight[y][a] += w
        rows = [(x, min(g)) for g in group.values() for x in sorted(g)]
        return pd.DataFrame(rows, columns=["id", "community"])

    return run


def communities(nodes: DataFrame, edges: DataFrame, most: int = 800, wide: str = "modularity") -> DataFrame:
    """(id, community) by modularity in each component of five nodes or more; up to four nodes are one community.

    Components of at most ``most`` nodes are merged greedily, one in a task; larger ones by ``louvain``, in joins. With
    ``wide="folders"`` the nodes of one folder (of ``file``, if there is such a column) of a larger component are one
    community instead. A community's smallest id, or component and folder, names it.
    """
    ship(nodes.sparkSession)
    part = written(connected(nodes, edges))
    size = part.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    sized = written(part.join(size, "component"))
    fit = sized.where(F.col("n") <= most).select("id", "component")
    both = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    found = both.join(fit, F.col("a") == F.col("id")).select("component", "a", "b").groupBy("component").applyInPandas(_greedy(most), "id string, community string")
    large = sized.where(F.col("n") > most)
    if wide == "folders":
        folder = T.directory(F.col("file")) if "file" in nodes.columns else F.lit("")
        found = found.union(large.join(nodes.select("id", folder.alias("f")), "id").select("id", F.concat_ws("|", "component", "f").alias("community")))
    elif not large.isEmpty():
        found = found.union(louvain(both.select(F.col("a").alias("src"), F.col("b").alias("dst")).join(large.select(F.col("id").alias("src")), "src", "left_semi")))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def impact(nodes: DataFrame, edges: DataFrame, seed: str, most: int = 30, most_modules: int = 10) -> DataFrame:
    """One row: id, reach (nodes downstream but itself), callers, callees (ids, ``most`` of each), caller_count, modules.

    ``nodes`` has id and module; ``modules`` are those of the node and all downstream, ``most_modules`` of them.
    """
    start = nodes.where(F.col("id") == seed).select("id")
    down = closure(edges, start).join(nodes.select("id", "module"), "id")
    size = down.groupBy("module").agg(F.count(F.lit(1)).alias("n"))
    total = size.agg((F.sum("n") - 1).alias("reach"))
    first = size.orderBy("module").limit(most_modules).agg(F.array_sort(F.collect_list("module")).alias("modules"))

    def side(mine: str, other: str, name: str) -> DataFrame:
        near = edges.where(F.col(mine) == seed).select(F.col(other).alias("x")).distinct().orderBy("x").limit(most)
        return near.agg(F.array_sort(F.collect_list("x")).alias(name))

    count = edges.where(F.col("dst") == seed).agg(F.count(F.lit(1)).alias("caller_count"))
    out = total
    for part in (first, side("dst", "src", "callers"), side("src", "dst", "callees"), count):
        out = out.join(F.broadcast(part))  # one row each
    return out.select(F.lit(seed).alias("id"), "reach", "callers", "callees", "caller_count", "modules")


def _flows(most: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, found, first = Counter(), set(), defaultdict(list)
        for pdf in parts:
            for key, p, imported in zip(zip(pdf["sf"], pdf["tf"]), pdf["p"], pdf["imported"]):
                n[key] += 1
                if imported:
                    found.add(key)
                best = first[key]
                if len(best) < most or p < best[-1]:
                    insort(best, p)
                    del best[most:]
        if n:
            yield pd.DataFrame([(*key, c, key in found, first[key]) for key, c in n.items()], columns=["sf", "tf", "n", "imported", "pairs"])

    return run


def verified_flows(calls: DataFrame, imports: DataFrame | str | None = None, most: int = 10) -> DataFrame:
    """(src, dst, n, pairs, reason) of file pairs with direct calls and, with ``imports`` (sf, tf), an import.

    ``calls``: src, dst, sf, tf; ``imports`` may name a column of theirs, true where a call shows an import. The first ``most``
    calls of a pair, in order, are its ``pairs``; no list is longer. Each task counts its calls and keeps the first ones of
    its pairs in one pass; only those are sorted and shuffled.
    """
    ship(calls.sparkSession)
    imported = F.col(imports) if isinstance(imports, str) else F.lit(True)
    rows = calls.where("sf is not null and tf is not null").select("sf", "tf", F.concat_ws(">", "src", "dst").alias("p"), F.coalesce(imported, F.lit(False)).alias("imported"))
    part = written(rows.mapInPandas(_flows(most), "sf string, tf string, n long, imported boolean, pairs array<string>"))
    n = part.groupBy("sf", "tf").agg(F.sum("n").alias("n"), F.max("imported").alias("imported")).where("imported").drop("imported")
    pair = part.select("sf", "tf", F.explode("pairs").alias("p"))
    first = top_per(pair, most, ["sf", "tf"], "p").groupBy("sf", "tf").agg(F.array_sort(F.collect_list("p")).alias("pairs"))
    out = n.join(first, ["sf", "tf"])
    if isinstance(imports, DataFrame):
        out = out.join(imports.select("sf", "tf").distinct(), ["sf", "tf"], "left_semi")
    reason = F.concat(F.lit("Valid: "), F.col("n"), F.lit(" direct calls" + (" with import" if imports is not None else "")))
    return out.select(F.col("sf").alias("src"), F.col("tf").alias("dst"), "n", "pairs", reason.alias("reason"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    keep = ids.select("id")
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")


def merge_view(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """A view's nodes and those of ``more`` whose id it lacks; what it has stays as it is."""
    return nodes.unionByName(more.dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti").select(*nodes.columns))


def descendants(links: DataFrame, node: str) -> DataFrame:
    """(id) of all below a node in a parent table (id, parent), itself not among them."""
    edges = links.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    start = links.sparkSession.createDataFrame([(node,)], "id string")
    return closure(edges, start).where(F.col("id") != node)


def remove_subtree(nodes: DataFrame, edges: DataFrame, node: str, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, parent) and edges (src, dst) without what is below a node, and without itself unless ``keep``."""
    gone = descendants(nodes.select("id", "parent"), node)
    gone = written(gone if keep else gone.union(nodes.where(F.col("id") == node).select("id")))
    left = nodes.join(gone, "id", "left_anti")
    return left, edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select(*edges.columns)


def deep_expand(edges: DataFrame, node: str, hops: int = 3, most: int = 60) -> DataFrame:
    """(id, hop, parent): up to ``most`` new nodes within ``hops`` of a node, the first visited."""
    start = edges.sparkSession.createDataFrame([(node,)], "id string")
    found = bfs(edges, start, hops).where("hop > 0")
    return found.orderBy("visit").limit(most).select("id", "hop", "parent")


def hover(edges: DataFrame, node: str) -> DataFrame:
    """(id) of a node and all it shares an edge with."""
    near = edges.where((F.col("src") == node) | (F.col("dst") == node))
    return near.select(F.explode(F.array("src", "dst")).alias("id")).union(edges.sparkSession.createDataFrame([(node,)], "id string")).distinct()


def affected_modules(members: DataFrame, changed: DataFrame) -> DataFrame:
    """(module) of modules with a file (module, file) among the changed ones (file)."""
    return members.join(changed.select("file").distinct(), "file", "left_semi").select("module").distinct()


def roots(links: DataFrame) -> DataFrame:
    """(id, root, depth) by pointer jumping over a parent table (id, parent, null at roots); a cycle stops at 32 jumps."""
    state = links.select("id", F.coalesce("parent", "id").alias("root"), F.col("parent").isNotNull().cast("int").alias("depth"))
    for _ in range(32):
        up = state.select(F.col("id").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        state = written(state.join(up, "root", "left").select("id", F.coalesce("r2", "root").alias("root"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.coalesce("d2", F.lit(0)) > 0).alias("moved")))
        moved = state.where("moved").isEmpty()
        state = state.drop("moved")
        if moved:
            break
    return state


def top_per(df: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
