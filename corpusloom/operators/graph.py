"""Connected components of an edge table by label spreading with pointer jumping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.storage import cut_lineage, drop


#: Edges of a node that are joined with its label in one place, at least; nodes with more edges, at most.
SPOKES, HUBS = 4096, 1 << 16


def _both(edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, DataFrame]:
    """Every edge in both directions as a and b; and node, least and n: every node's smallest neighbour and how many it has."""
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    return both, cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count("*").alias("n")))


def _spread(both: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Every edge with its salt; and node, salts of the nodes whose edges are spread over many salts, which are at most HUBS.

    Where no node has so many edges, there is no salt, and None for these nodes."""
    n, most = ends.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    spokes = max(SPOKES, -(-n // HUBS))
    if most <= spokes:
        return both, None
    hubs = cut_lineage(ends.select("node", F.ceil(F.col("n") / spokes).cast("int").alias("salts")).where("salts > 1"))
    salt = F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")), F.lit(0)).cast("int")
    salted = cut_lineage(both.join(F.broadcast(hubs), F.col("b") == F.col("node"), "left").select("a", "b", salt.alias("salt")))
    drop(both)
    return salted, hubs


def _salted(edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, DataFrame | None]:
    return _spread(*_both(edges, src, dst))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node and label, the smallest node of its component, for every node with an edge to another one.

    Minima are summed up before each shuffle, and edges of a node with very many neighbours meet copies of its label, so
    that it's no hot spot. Every step costs the driver a plan and as many tasks as there are partitions, so nothing is
    written twice, and salts are joined only where a node needs them."""
    both, held = _both(edges, src, dst)
    both, hubs = _spread(both, held)
    labels = held.select("node", F.least("node", "least").alias("label"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    while True:
        if hubs is None:
            met = both.join(labels, F.col("b") == F.col("node"))
        else:
            known = labels.join(F.broadcast(hubs.withColumnRenamed("node", "_hub")), F.col("node") == F.col("_hub"), "left").select("node", "label", copies.alias("_salt"))
            met = both.join(known, (F.col("b") == F.col("node")) & (F.col("salt") == F.col("_salt")))
        near = met.groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("n")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("new"))
        above = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        spread = cut_lineage(step.join(above, F.col("new") == F.col("up"), "left").select("node", "old", F.least("new", F.coalesce("top", F.col("new"))).alias("label")))
        drop(held)
        held, labels = spread, spread.select("node", "label")
        if spread.where("label <> old").isEmpty():
            drop(both, *[hubs] * (hubs is not None))
            return labels


def spanning_forest(edges: DataFrame) -> DataFrame:
    """a, b and similarity of a maximum spanning forest of the edges (a < b, similarity), of equal ones the largest names.

    In each round every tree takes its best edge to another tree, and trees joined by such edges become one: at least half
    of all trees with an edge are gone after a round. Edges inside a tree are left out of the next round."""
    kind = edges.schema["a"].dataType
    left = cut_lineage(edges.where("a <> b").groupBy("a", "b").agg(F.max("similarity").alias("similarity")).withColumns({"ta": F.col("a"), "tb": F.col("b")}))
    forest = None
    while not left.isEmpty():
        edge = F.struct("similarity", "a", "b", "ta", "tb")
        ends = left.select(F.col("ta").alias("tree"), edge.alias("edge")).unionByName(left.select(F.col("tb").alias("tree"), edge.alias("edge")))
        best = cut_lineage(ends.groupBy("tree").agg(F.max("edge").alias("edge")))
        taken = best.select("edge.a", "edge.b", "edge.similarity").distinct()
        forest = taken if forest is None else forest.unionByName(taken)
        # every tree points along its edge; of two that point at each other, the smaller one stays
        to = F.when(F.col("tree") == F.col("edge.ta"), F.col("edge.tb")).otherwise(F.col("edge.ta"))
        way = best.select("tree", to.alias("to"))
        back = way.select(F.col("tree").alias("_t"), F.col("to").alias("_back"))
        mutual = way.join(back, F.col("to") == F.col("_t")).select("tree", F.when((F.col("_back") == F.col("tree")) & (F.col("tree") < F.col("to")), F.col("tree")).otherwise(F.col("to")).alias("to"))
        roots = _jumped(mutual)
        named = lambda c: roots.select(F.col("tree").alias(f"_{c}"), F.col("to").alias(f"_n{c}"))
        joined = left.join(named("ta"), F.col("ta") == F.col("_ta")).join(named("tb"), F.col("tb") == F.col("_tb"))
        after = cut_lineage(joined.where("_nta <> _ntb").select("a", "b", "similarity", F.col("_nta").alias("ta"), F.col("_ntb").alias("tb")))
        drop(left, roots)
        left = after
    if forest is None:
        return edges.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "similarity").limit(0)
    return cut_lineage(forest)


def _jumped(way: DataFrame) -> DataFrame:
    """tree and the root that its way (tree, to) ends at; every tree's way ends at one that points to itself."""
    held = cut_lineage(way)
    while True:
        on = held.select(F.col("tree").alias("_t"), F.col("to").alias("_to"))
        step = cut_lineage(held.join(on, F.col("to") == F.col("_t")).select("tree", F.col("_to").alias("to"), (F.col("_to") != F.col("to")).alias("moved")))
        drop(held)
        held = step
        if held.where("moved").isEmpty():
            return held


#: Vectors of a component whose tree is cut in one task; larger components are cut by joins until their parts are smaller.
WHOLE = 1 << 18


def bounded_components(vectors: DataFrame, threshold: float, most: int = 60, step: float = 0.03, last: float = 0.97) -> DataFrame:
    """id, group and slice for every vector: components of at most `most` members.

    A larger component is cut again at a threshold higher by `step`; from `last` on it's sliced in id order. group is the
    smallest id of the component. All thresholds are cuts of one spanning forest of the vectors, which are joined once.
    vectors: id, embedding."""
    from corpusloom.operators.similarity import similar_trees

    todo, at, done = cut_lineage(vectors.select("id")), threshold, []
    forest = spanning_forest(similar_trees(vectors, threshold))
    while True:
        labels = connected_components(forest.where(F.col("similarity") >= at), "a", "b")
        named = todo.join(labels, F.col("id") == F.col("node"), "left").select("id", F.coalesce("label", "id").alias("group"))
        sizes = named.groupBy(F.col("group").alias("_g")).agg(F.count("*").alias("size"))
        sized = cut_lineage(named.join(sizes, F.col("group") == F.col("_g")).drop("_g"))
        done.append(sized.where(F.col("size") <= most).select("id", "group", F.lit(0).alias("slice")))
        if at >= last:
            done.append(_sliced(sized.where(F.col("size") > most).select("id", "group"), most))
            break
        some = sized.where((F.col("size") > most) & (F.col("size") <= WHOLE)).select("id", "group")
        own = forest.join(some, F.col("a") == F.col("id")).select(F.col("group").alias("_g"), "a", "b", "similarity")
        cut = some.groupBy("group").cogroup(own.groupBy("_g")).applyInArrow(_cut(at, most, step, last), f"{_kinds(some)}, slice int")
        done.append(cut)
        todo = sized.where(F.col("size") > WHOLE).select("id")
        if todo.isEmpty():
            break
        forest = cut_lineage(forest.join(todo, F.col("a") == F.col("id"), "left_semi"))
        at += step
        least = forest.agg(F.min("similarity")).first()[0]
        while at < last and least is not None and least >= at:  # nothing comes apart
            at += step
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _kinds(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _cut(at: float, most: int, step: float, last: float):
    """A component's members by the thresholds above `at`, from its tree."""

    def parts(members: list, edges: list) -> dict:
        up = {m: m for m in members}
        for a, b, _ in edges:
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            up[max(a, b)] = min(a, b)
        out: dict = {}
        for m in members:
            root = m
            while up[root] != root:
                root = up[root]
            out.setdefault(root, ([], []))[0].append(m)
            up[m] = root
        for e in edges:
            out[up[e[0]]][1].append(e)
        return out

    def cut(key, members, tree):
        ids, groups, slices = [], [], []
        todo = [(at + step, sorted(members.column("id").to_pylist()), list(zip(*(tree.column(c).to_pylist() for c in ("a", "b", "similarity")))))]
        while todo:
            level, held, edges = todo.pop()
            for root, (own, inside) in parts(held, [e for e in edges if e[2] >= level]).items():
                if len(own) > most and level < last:
                    todo.append((level + step, own, inside))
                    continue
                for k, m in enumerate(own):
                    ids.append(m)
                    groups.append(root)
                    slices.append(k // most)
        kind = members.schema.field("id").type
        return pa.table([pa.array(ids, kind), pa.array(groups, kind), pa.array(slices, pa.int32())], names=["id", "group", "slice"])

    return cut


def _sliced(rows: DataFrame, most: int) -> DataFrame:
    """id, group and slice: the group's ids in order, `most` in each slice. Rows are sorted in ranges and counted by range,
    so a large group isn't one task."""
    ordered = cut_lineage(rows.orderBy("group", "id").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = ordered.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row for each range
    placed = placed.withColumn("_place", F.col("_before") + F.col("_at") - F.shiftleft("_part", 33))
    first = placed.groupBy(F.col("group").alias("_g")).agg(F.min("_place").alias("_first"))
    return placed.join(first, F.col("group") == F.col("_g")).select("id", "group", F.floor((F.col("_place") - F.col("_first")) / most).cast("int").alias("slice"))
