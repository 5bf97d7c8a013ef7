"""Graph operators on edge tables (src, dst); vertices are long ids."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genloom.runtime import discard, materialize, shuffled


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex is either a root or points to one root; then the components are found."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col("b").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("e"))
    each = ends.groupBy("e.v").agg(F.sum("e.x").alias("x"), F.sum("e.y").alias("y"))
    return not each.agg(F.count_if(F.expr("x > 1 OR (x > 0 AND y > 0)"))).first()[0]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(vertex, component): the smallest vertex that each vertex of an edge can reach, direction ignored.

    Alternates large-star and small-star steps until the edge set is a set of stars. Each step is one aggregate with
    map-side combine and one equi join by a shuffle (which AQE can split on a hot hub); rounds grow with the logarithm of the
    longest path. Edges with a null end are ignored; a self loop only names its vertex.
    """
    ends = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).dropna()
    loops = ends.filter("a = b").select(F.col("a").alias("vertex")).distinct()
    cur = materialize(
        ends.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    for n in range(max_rounds + 1):
        if _are_stars(cur):
            break
        if n == max_rounds:
            raise ValueError("no stars after max_rounds")
        # large-star: every larger neighbour of u moves to the smallest vertex around u
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(shuffled(low), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # small-star: every smaller neighbour of u, and u, move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(shuffled(least), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, cur = cur, materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc")
        discard(last)
    stars = cur.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("vertex"), "component")
    roots = cur.select(F.col("b").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    lone = loops.withColumn("component", F.col("vertex"))
    return stars.unionByName(roots).unionByName(lone).groupBy("vertex").agg(F.min("component").alias("component"))


def ordered_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges listed under their smaller end only: an edge whose first end is larger is ignored."""
    return edges.filter(F.col(src) <= F.col(dst))


def components_of(vertices: DataFrame, edges: DataFrame, vertex: str = "vertex") -> DataFrame:
    """(vertex, component) of all vertices, isolated ones included, under the rule of ordered_edges."""
    found = connected_components(ordered_edges(edges))
    out = vertices.select(F.col(vertex).cast("long").alias("vertex")).distinct().join(shuffled(found), "vertex", "left")
    return out.select("vertex", F.coalesce("component", "vertex").alias("component"))


#: Vertices or edges of a component that an operator which holds a component at a time takes; it refuses larger ones.
LARGEST = 5_000_000


def _refuse(groups: DataFrame, key: str, most: int) -> None:
    """Raises if a group has more than so many rows, before anything is gathered."""
    top = groups.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 0
    if top > most:
        raise ValueError(f"a component of {top} rows is more than one task is to hold ({most})")


def co_membership(components: DataFrame, most: int = LARGEST) -> DataFrame:
    """(component, size, members): sorted members once for each component; join it by component to list them per vertex.

    A component's members make one array; a component of more than most vertices is refused.
    """
    _refuse(components, "component", most)
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("vertex")).alias("members"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "__s", "dst": "src"}).withColumnRenamed("__s", "dst").select(*edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    """(vertex, out_degree, in_degree)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("vertex"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("vertex"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.vertex").alias("vertex")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def transitive_closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(src, dst) of all paths of one edge or more; paths double in length each round. The result may hold every pair of
    vertices: that is what is asked for. Raises where max_rounds end first."""
    reach = materialize(edges.select("src", "dst").distinct(), "closure")
    n = reach.count()
    for _ in range(max_rounds):
        step = reach.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(reach.select(F.col("src").alias("m"), F.col("dst").alias("b")), "m")
        reach = materialize(reach.union(step.select("a", "b")).distinct(), "closure")
        if (more := reach.count()) == n:
            return reach
        n = more
    raise ValueError("paths are longer than max_rounds doublings")


def _compact(rows: DataFrame, n: int, name: str) -> DataFrame:
    """rows as one table every 50 rounds, so that a plan doesn't grow with the rounds."""
    return materialize(rows, name) if n % 50 == 0 else rows


def breadth_first(edges: DataFrame, roots: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(vertex, level): least number of edges from a root. Raises where a given max_rounds ends before the frontier does."""
    seen = front = materialize(roots.select("vertex").distinct().withColumn("level", F.lit(0)), "bfs")
    for level in itertools.count(1):
        nxt = edges.join(front, edges.src == front.vertex).select(F.col("dst").alias("vertex")).distinct().join(seen, "vertex", "left_anti")
        front = materialize(nxt.withColumn("level", F.lit(level)), "bfs")
        if front.isEmpty():
            return seen
        if level == max_rounds:
            raise ValueError("the frontier is not empty after max_rounds")
        seen = _compact(seen.unionByName(front), level, "bfs")


def shortest_paths(edges: DataFrame, sources: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(source, vertex, distance) by rounds of relaxation; weights may be negative, cycles of negative weight may not be.

    Only vertices whose distance fell are relaxed again, so rounds grow with the longest best path and work with change.
    """
    best = changed = materialize(sources.select(F.col("vertex").alias("source"), "vertex", F.lit(0.0).alias("distance")), "paths")
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    for _ in range(max_rounds):
        step = changed.join(e, changed.vertex == e.src).select("source", F.col("dst").alias("vertex"), (F.col("distance") + F.col("weight")).alias("distance"))
        step = step.groupBy("source", "vertex").agg(F.min("distance").alias("distance"))
        old = best.withColumnRenamed("distance", "old")
        changed = materialize(step.join(old, ["source", "vertex"], "left").filter("old IS NULL OR distance < old").select("source", "vertex", "distance"), "paths")
        if changed.isEmpty():
            return best
        best = materialize(best.unionByName(changed).groupBy("source", "vertex").agg(F.min("distance").alias("distance")), "paths")
    raise ValueError("no end after max_rounds: a cycle of negative weight is reachable")


def all_pairs(edges: DataFrame) -> DataFrame:
    """shortest_paths from every vertex; the result holds every pair that a path joins."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()
    return shortest_paths(edges, ends)


def topological_levels(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(vertex, level): the most edges on a path to a vertex; ordering by level is a topological order. Raises on a cycle,
    and where a given max_rounds ends before the levels do."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()
    left, out = materialize(edges.select("src", "dst").distinct(), "topo"), None
    todo = materialize(ends, "topo")
    for level in itertools.count():
        free = materialize(todo.join(left.select(F.col("dst").alias("vertex")).distinct(), "vertex", "left_anti"), "topo")
        if free.isEmpty():
            break
        if level == max_rounds:
            raise ValueError("levels are left after max_rounds")
        found = free.withColumn("level", F.lit(level))
        out = found if out is None else _compact(out.unionByName(found), level, "topo")
        todo = materialize(todo.join(free, "vertex", "left_anti"), "topo")
        left = materialize(left.join(free, left.src == free.vertex, "left_anti"), "topo")
    if not todo.isEmpty():
        raise ValueError("the graph has a cycle")
    return out if out is not None else ends.withColumn("level", F.lit(0))


def dag_paths(edges: DataFrame, longest: bool = True) -> DataFrame:
    """(vertex, distance): longest or shortest weighted path that ends in each vertex, in an acyclic graph; roots have 0."""
    sign = -1.0 if longest else 1.0
    e = edges.select("src", "dst", (F.col("weight") * sign).alias("weight"))
    roots = e.select(F.col("src").alias("vertex")).distinct().join(e.select(F.col("dst").alias("vertex")).distinct(), "vertex", "left_anti")
    return shortest_paths(e, roots).groupBy("vertex").agg((F.min("distance") * sign).alias("distance"))


def minimum_spanning_forest(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The edges (src, dst, weight) of a spanning forest of least weight, by Borůvka rounds; ties go by the ends' ids."""
    e = materialize(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").distinct(), "mst")
    label = materialize(e.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct().withColumn("component", F.col("vertex")), "mst")
    chosen = None
    for _ in range(max_rounds):
        a, b = label.select(F.col("vertex").alias("src"), F.col("component").alias("ca")), label.select(F.col("vertex").alias("dst"), F.col("component").alias("cb"))
        open_ = e.join(a, "src").join(b, "dst").filter("ca <> cb")
        sides = open_.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("weight", "src", "dst").alias("x"))
        best = materialize(sides.groupBy("c").agg(F.min("x").alias("x")).select("x.*").distinct(), "mst")
        if best.isEmpty():
            return (chosen if chosen is not None else best).select("src", "dst", "weight")
        chosen = best if chosen is None else chosen.unionByName(best)
        joined = best.join(a, "src").join(b, "dst")
        merged = connected_components(joined, "ca", "cb").withColumnRenamed("vertex", "old").withColumnRenamed("component", "new")
        label = materialize(label.join(merged, label.component == merged.old, "left").select("vertex", F.coalesce("new", "component").alias("component")), "mst")
    raise ValueError("components are left after max_rounds")


def strong_components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(vertex, component): smallest vertex that each can reach and be reached from. Raises where a given max_rounds ends
    before every vertex is settled.

    Colours by the smallest vertex that reaches each (forward), then takes those that reach their colour's vertex back;
    what is left goes on, so work falls with every round.
    """
    left = materialize(edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct(), "scc")
    e, out = materialize(edges.select("src", "dst").distinct(), "scc"), None
    for n in itertools.count():
        if left.isEmpty():
            break
        if n == max_rounds:
            raise ValueError("vertices are left after max_rounds")
        colour = left.withColumn("colour", F.col("vertex"))
        while True:
            step = e.join(colour, e.src == colour.vertex).groupBy("dst").agg(F.min("colour").alias("c"))
            new = materialize(colour.join(step, colour.vertex == step.dst, "left").select("vertex", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("moved")), "scc")
            colour = new.select("vertex", "colour")
            if new.filter("moved").isEmpty():
                break
        same = e.join(colour.select(F.col("vertex").alias("src"), F.col("colour").alias("k")), "src").join(colour.select(F.col("vertex").alias("dst"), F.col("colour").alias("k2")), "dst").filter("k = k2").select("src", "dst", "k")
        found = front = materialize(colour.filter("vertex = colour"), "scc")
        while True:
            back = same.join(front, same.dst == front.vertex).select(F.col("src").alias("vertex"), F.col("k").alias("colour")).distinct().join(found, "vertex", "left_anti")
            front = materialize(back, "scc")
            if front.isEmpty():
                break
            found = found.unionByName(front)
        found = materialize(found.select("vertex", F.col("colour").alias("component")), "scc")
        out = found if out is None else _compact(out.unionByName(found), n, "scc")
        left = materialize(left.join(found, "vertex", "left_anti"), "scc")
        e = materialize(e.join(left.withColumnRenamed("vertex", "src"), "src", "left_semi").join(left.withColumnRenamed("vertex", "dst"), "dst", "left_semi"), "scc")
    return out if out is not None else left.withColumn("component", F.col("vertex"))


def flow_cost(edges: DataFrame) -> DataFrame:
    """Total cost of a flow given (capacity, residual, weight) of the edges."""
    return edges.filter("capacity > 0").agg(F.coalesce(F.sum((F.col("capacity") - F.col("residual")) * F.col("weight")), F.lit(0)).alias("cost"))


def make_connected(components: DataFrame) -> DataFrame:
    """Edges (src, dst) between successive components' smallest vertices, which connect the graph.

    Components are dealt into ranges; each links its own, and the first of a range to the last of the range before, of
    which there are as few as ranges.
    """
    from pyspark.sql import Window as W

    roots = materialize(components.select("component").distinct().repartitionByRange("component").withColumn("r", F.spark_partition_id()), "roots")
    inside = roots.select("r", F.lag("component").over(W.partitionBy("r").orderBy("component")).alias("src"), F.col("component").alias("dst"))
    ends = roots.groupBy("r").agg(F.min("component").alias("dst"), F.max("component").alias("last"))
    across = ends.select("r", F.lag("last").over(W.orderBy("r")).alias("src"), "dst")  # a row a range
    return inside.unionByName(across).filter("src IS NOT NULL").select("src", "dst")


def reconcile(updates: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """The value of the highest version of each key."""
    return updates.groupBy(key).agg(F.max_by(value, version).alias(value))


def per_component(edges: DataFrame, function, schema: str, most: int = LARGEST) -> DataFrame:
    """function(pandas frame of a component's edges) → pandas frame, for algorithms that are sequential by nature. A
    component of more than most edges is refused."""
    comp = connected_components(edges)
    grouped = edges.join(shuffled(comp), edges.src == comp.vertex).drop("vertex")
    _refuse(grouped, "component", most)
    return grouped.groupBy("component").applyInPandas(function, schema)


def _adjacency(rows) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for a, b in zip(rows["src"].tolist(), rows["dst"].tolist()):
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def maximal_cliques(edges: DataFrame) -> DataFrame:
    """(component, clique): each maximal clique as a sorted array."""
    import pandas as pd

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        adj, out = _adjacency(rows[rows.src != rows.dst]), []
        stack = [(frozenset(), set(adj), set())]
        while stack:
            held, may, done = stack.pop()
            if not may and not done:
                if held:
                    out.append(sorted(held))
                continue
            pivot = max(may | done, key=lambda v: len(adj[v] & may))
            for v in sorted(may - adj[pivot]):
                stack.append((held | {v}, may & adj[v], done & adj[v]))
                may = may - {v}
                done = done | {v}
        return pd.DataFrame({"component": int(rows["component"].iloc[0]), "clique": sorted(out)})

    return per_component(edges, find, "component long, clique array<long>")


def vertex_colouring(edges: DataFrame) -> DataFrame:
    """(vertex, colour): each vertex in order of its id takes the least colour that no neighbour has."""
    import pandas as pd

    def colour(rows: pd.DataFrame) -> pd.DataFrame:
        adj, got = _adjacency(rows[rows.src != rows.dst]), {}
        for v in sorted(adj):
            used = {got[u] for u in adj[v] if u in got}
            got[v] = next(c for c in range(len(used) + 1) if c not in used)
        return pd.DataFrame({"vertex": list(got), "colour": list(got.values())})

    return per_component(edges, colour, "vertex long, colour int")


def articulation(edges: DataFrame) -> DataFrame:
    """(vertex) whose removal parts its component, by depth-first low links over an explicit stack."""
    import pandas as pd

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        adj = {v: sorted(n) for v, n in _adjacency(rows[rows.src != rows.dst]).items()}
        order, low, out = {}, {}, set()
        for root in sorted(adj):
            if root in order:
                continue
            order[root] = low[root] = len(order)
            stack, kids = [(root, None, iter(adj[root]))], 0
            while stack:
                v, up, it = stack[-1]
                w = next(it, None)
                if w is None:
                    stack.pop()
                    if up is not None:
                        low[up] = min(low[up], low[v])
                        if up != root and low[v] >= order[up]:
                            out.add(up)
                elif w not in order:
                    order[w] = low[w] = len(order)
                    kids += v == root
                    stack.append((w, v, iter(adj[w])))
                elif w != up:
                    low[v] = min(low[v], order[w])
            if kids > 1:
                out.add(root)
        return pd.DataFrame({"vertex": pd.Series(sorted(out), dtype="int64")})

    return per_component(edges, find, "vertex long")


def depth_first(edges: DataFrame) -> DataFrame:
    """(vertex, discovered, finished) of a depth-first walk of each component, smallest ids first; directed edges."""
    import pandas as pd

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        out_of: dict[int, list[int]] = {v: [] for v in sorted({*rows["src"], *rows["dst"]})}
        for a, b in sorted({*zip(rows["src"].tolist(), rows["dst"].tolist())}):
            out_of[a].append(b)
        seen, done, t = {}, {}, 0
        for root in out_of:
            if root in seen:
                continue
            seen[root], t = t, t + 1
            stack = [(root, iter(out_of[root]))]
            while stack:
                v, it = stack[-1]
                w = next((x for x in it if x not in seen), None)
                if w is None:
                    done[v], t = t, t + 1
                    stack.pop()
                else:
                    seen[w], t = t, t + 1
                    stack.append((w, iter(out_of[w])))
        return pd.DataFrame({"vertex": list(seen), "discovered": list(seen.values()), "finished": [done[v] for v in seen]})

    return per_component(edges, walk, "vertex long, discovered long, finished long")


def max_flow(edges: DataFrame, source: int, sink: int) -> DataFrame:
    """(src, dst, flow) of a maximum flow by shortest augmenting paths, for graphs of one component's size."""
    import pandas as pd

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        cap: dict[int, dict[int, float]] = {}
        for a, b, c in zip(rows["src"].tolist(), rows["dst"].tolist(), rows["capacity"].tolist()):
            cap.setdefault(a, {})[b] = cap.get(a, {}).get(b, 0) + c
            cap.setdefault(b, {}).setdefault(a, 0)
        left = {a: dict(n) for a, n in cap.items()}
        while source in left and sink in left:
            came, queue = {source: None}, [source]
            for v in queue:
                for w, c in left[v].items():
                    if c > 0 and w not in came:
                        came[w] = v
                        queue.append(w)
            if sink not in came:
                break
            path, v = [], sink
            while came[v] is not None:
                path.append((came[v], v))
                v = came[v]
            push = min(left[a][b] for a, b in path)
            for a, b in path:
                left[a][b] -= push
                left[b][a] += push
        pairs = sorted({*zip(rows["src"].tolist(), rows["dst"].tolist())})
        return pd.DataFrame([(a, b, float(max(0.0, cap[a][b] - left[a][b]))) for a, b in pairs], columns=["src", "dst", "flow"])

    return per_component(edges, solve, "src long, dst long, flow double")


def edge_colouring(edges: DataFrame) -> DataFrame:
    """(src, dst, colour): each edge in order of its ends takes the least colour that no edge at either end has."""
    import pandas as pd

    def colour(rows: pd.DataFrame) -> pd.DataFrame:
        used: dict[int, set[int]] = {}
        out = []
        for a, b in sorted({(min(a, b), max(a, b)) for a, b in zip(rows["src"].tolist(), rows["dst"].tolist()) if a != b}):
            taken = used.setdefault(a, set()) | used.setdefault(b, set())
            c = next(c for c in range(len(taken) + 1) if c not in taken)
            used[a].add(c)
            used[b].add(c)
            out.append((a, b, c))
        return pd.DataFrame(out, columns=["src", "dst", "colour"])

    return per_component(edges, colour, "src long, dst long, colour int")


def edge_connectivity(edges: DataFrame) -> DataFrame:
    """(component, connectivity): the least number of undirected edges whose removal parts a component (Stoer & Wagner)."""
    import pandas as pd

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        w: dict[int, dict[int, int]] = {}
        for a, b in {(min(a, b), max(a, b)) for a, b in zip(rows["src"].tolist(), rows["dst"].tolist()) if a != b}:
            w.setdefault(a, {})[b] = w.setdefault(b, {})[a] = 1
        best = None
        while len(w) > 1:
            start = min(w)
            seen, order, gain = {start}, [start], dict(w[start])
            while len(order) < len(w):
                v = max((x for x in w if x not in seen), key=lambda x: (gain.get(x, 0), -x))
                seen.add(v)
                order.append(v)
                for u, c in w[v].items():
                    if u not in seen:
                        gain[u] = gain.get(u, 0) + c
            s, t = order[-2], order[-1]
            total = sum(w[t].values())
            best = total if best is None else min(best, total)
            for u, c in w.pop(t).items():
                w[u].pop(t)
                if u != s:
                    w[s][u] = w[s].get(u, 0) + c
                    w[u][s] = w[s][u]
        return pd.DataFrame({"component": [int(rows["component"].iloc[0])], "connectivity": [best or 0]})

    return per_component(edges, cut, "component long, connectivity int")


def incremental_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """components (vertex, component) with new edges taken in. Edges are read as links between components, so the rounds
    work on what the new edges touch and the known components are relabelled by one join."""
    known = components.select(F.col("vertex").alias("v"), F.col("component").alias("c"))
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).dropna()
    for end, name in (("src", "a"), ("dst", "b")):
        e = e.join(shuffled(known), F.col(end) == F.col("v"), "left").withColumn(name, F.coalesce("c", end)).drop("v", "c")
    e = materialize(e, "new-links")
    merged = materialize(connected_components(e, "a", "b").select(F.col("vertex").alias("old"), F.col("component").alias("new")), "merged")
    old = components.join(shuffled(merged), F.col("component") == F.col("old"), "left").select("vertex", F.coalesce("new", "component").alias("component"))
    fresh = e.select(F.explode(F.array(F.struct(F.col("src").alias("vertex"), F.col("a").alias("old")), F.struct(F.col("dst").alias("vertex"), F.col("b").alias("old")))).alias("x")).select("x.*").distinct()
    fresh = fresh.join(shuffled(components.select("vertex")), "vertex", "left_anti").join(shuffled(merged), "old").select("vertex", F.col("new").alias("component"))
    return old.unionByName(fresh)


def biconnected(edges: DataFrame) -> DataFrame:
    """(src, dst, block_src, block_dst): each undirected edge with the least edge of its biconnected component.

    Depth-first low links over an explicit stack of edges, a component at a time.
    """
    import pandas as pd

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        adj = {v: sorted(n) for v, n in _adjacency(rows[rows.src != rows.dst]).items()}
        order, low, out, held = {}, {}, [], []

        def close(upto):
            at = held.index(upto)
            block = [(min(e), max(e)) for e in held[at:]]
            del held[at:]
            out.extend((*e, *min(block)) for e in block)

        for root in sorted(adj):
            if root in order:
                continue
            order[root] = low[root] = len(order)
            stack = [(root, None, iter(adj[root]))]
            while stack:
                v, up, it = stack[-1]
                w = next(it, None)
                if w is None:
                    stack.pop()
                    if up is not None:
                        low[up] = min(low[up], low[v])
                        if low[v] >= order[up]:
                            close((up, v))
                elif w not in order:
                    held.append((v, w))
                    order[w] = low[w] = len(order)
                    stack.append((w, v, iter(adj[w])))
                elif w != up and order[w] < order[v]:
                    held.append((v, w))
                    low[v] = min(low[v], order[w])
        return pd.DataFrame(out, columns=["src", "dst", "block_src", "block_dst"])

    return per_component(edges, find, "src long, dst long, block_src long, block_dst long")


def simple_cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(cycle): the simple directed cycles of at most so many edges, each as an array that begins with its smallest vertex.

    Paths grow by one edge a round from their smallest vertex; their number may be exponential in longest.
    """
    e = materialize(edges.select("src", "dst").distinct(), "cycles")
    paths, out = e.filter("src <> dst AND dst > src").select(F.array("src", "dst").alias("p")), e.filter("src = dst").select(F.array("src").alias("cycle"))
    for n in range(2, longest + 1):
        paths = materialize(paths, "paths")
        step = paths.join(e, F.element_at("p", -1) == F.col("src"))
        out = out.unionByName(step.filter(F.col("dst") == F.col("p")[0]).select(F.col("p").alias("cycle")))
        paths = step.filter((F.col("dst") > F.col("p")[0]) & ~F.array_contains("p", F.col("dst"))).select(F.concat("p", F.array("dst")).alias("p"))
        if n < longest and paths.isEmpty():
            break
    return out


def min_cost_flow(edges: DataFrame, source: int, sink: int) -> DataFrame:
    """(src, dst, flow) of a maximum flow of least cost, from edges with capacity and weight, by shortest augmenting paths;
    for graphs of one component's size. There may be no cycle of negative weight."""
    import pandas as pd

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        ends, cap, cost = [], [], []
        for a, b, c, w in zip(rows["src"].tolist(), rows["dst"].tolist(), rows["capacity"].tolist(), rows["weight"].tolist()):
            ends += [(a, b), (b, a)]
            cap += [float(c), 0.0]
            cost += [float(w), -float(w)]
        while True:
            far, came = {source: 0.0}, {}
            for _ in range(len({v for e in ends for v in e})):
                moved = False
                for i, (a, b) in enumerate(ends):
                    if cap[i] > 0 and a in far and far[a] + cost[i] < far.get(b, float("inf")) - 1e-9:
                        far[b], came[b], moved = far[a] + cost[i], i, True
                if not moved:
                    break
            if sink not in far or sink == source:
                break
            path, v = [], sink
            while v != source:
                path.append(came[v])
                v = ends[came[v]][0]
            push = min(cap[i] for i in path)
            for i in path:
                cap[i] -= push
                cap[i ^ 1] += push
        return pd.DataFrame([(*ends[i], cap[i + 1]) for i in range(0, len(ends), 2)], columns=["src", "dst", "flow"])

    return per_component(edges, solve, "src long, dst long, flow double")


def lookup(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges between the given pairs (src, dst)."""
    return edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")


def without_edges(edges: DataFrame, pred) -> DataFrame:
    """Edges less those that pred holds for; edges of which it says nothing stay."""
    return edges.filter(~F.coalesce(pred, F.lit(False)))


def offsets(edges: DataFrame) -> DataFrame:
    """Compressed rows: (vertex, targets), the sorted targets of every vertex that has any."""
    return edges.groupBy(F.col("src").alias("vertex")).agg(F.array_sort(F.collect_list("dst")).alias("targets"))


def circle_layout(vertices: DataFrame, vertex: str, radius: float) -> DataFrame:
    """(vertex, x, y): vertices in order of their ids on a circle; ids must number 0 to n - 1."""
    n = vertices.agg(F.count(F.lit(1)).alias("n"))
    angle = F.lit(2 * 3.141592653589793) * F.col(vertex) / F.col("n")
    return vertices.crossJoin(F.broadcast(n)).select(F.col(vertex).alias("vertex"), (F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"))  # n is one row
