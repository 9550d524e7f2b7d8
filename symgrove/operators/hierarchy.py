"""Parent-child links to full hierarchies: path, depth, root, descendants, cycles.

Every node has at most one parent, so following the parent pointers leads each
component to its root or into its cycle. Pointer doubling finds that in
log(depth) rounds; a component is then co-located and walked depth first with
node colouring. A component of more than ``max_component`` nodes is never
gathered: its rows come from the doubling itself, and are the same.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrove.operators.skew import hot_join
from symgrove.session import cut, cut_counted

MAX_COMPONENT = MAX_RINGS = 100_000
PLAIN = "node_id long, parent_id long, root_id long, node_depth int, back_edge boolean, component long"
RESULT = PLAIN + ", path array<long>, n_descendants long"
#: Rows, and cells of their paths, that a walk holds before it hands them on.
HELD_ROWS, HELD_CELLS = 20_000, 1_000_000


def _clean_links(links: DataFrame) -> DataFrame:
    """One parent per child, the smallest; NULLs dropped, repeats once."""
    return links.select("child", "parent").dropna().groupBy("child").agg(F.min("parent").alias("parent"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def components(links: DataFrame, max_rings: int = MAX_RINGS) -> DataFrame:
    """node, parent (NULL for a root), comp, dist (steps to the root, -1 if a cycle is met), ring (whether the node is on a cycle).

    comp is the root, or the smallest node of the cycle. Each round doubles the
    pointer's reach and moves on only the nodes that have not met their root;
    hot pointers (one parent of very many children) are joined by broadcast. What
    never meets a root leads into a cycle. At most ``max_rings`` such nodes are
    followed round in one task; of more, once the reach is no less than their number,
    every pointer stands on a cycle and each node of a cycle is pointed to, so
    the cycles are exactly the nodes pointed to.
    """
    links = _clean_links(links)
    nodes = links.select(F.col("child").alias("node")).unionByName(links.select(F.col("parent").alias("node"))).distinct()
    st = nodes.join(links.withColumnRenamed("child", "node"), "node", "left").select(
        "node",
        "parent",
        F.coalesce("parent", "node").alias("ptr"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.least("node", F.coalesce("parent", "node")).alias("low"),
        F.col("parent").isNull().alias("done"),
    )
    open_rows = F.count_if(~F.col("done"))
    st, n = cut_counted(st, "pointers", open=open_rows)
    done, open_ = [st.filter("done")], st.filter("not done")
    n_open, reach, closed = n["open"], 1, False
    while n_open and not (closed and (reach >= n_open or n_open <= max_rings)):
        look = _union([*done, open_]).select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        new = hot_join(open_, look, ["ptr"], total=n_open).select(
            "node", "parent", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), F.least("low", "low2").alias("low"), F.col("done2").alias("done")
        )
        new, n = cut_counted(new, "pointers", open=open_rows)
        reach *= 2
        done.append(new.filter("done"))
        open_ = new.filter("not done")
        closed = n["open"] == n_open  # in each round some node reaches its root, as long as any can
        n_open = n["open"]
    tree = _union(done).select("node", "parent", F.col("ptr").alias("comp"), "dist", F.lit(False).alias("ring"))
    if not n_open:
        return tree
    if reach < n_open:  # few enough for one task
        cyc = open_.select("node", "parent").coalesce(1).mapInArrow(_rings, "node long, parent long, comp long, ring boolean")
    else:
        on = open_.select(F.col("ptr").alias("node")).distinct().join(open_.select("node", "low"), "node")
        cyc = hot_join(open_, on.select(F.col("node").alias("ptr"), F.col("low").alias("comp")), ["ptr"], total=n_open)
        cyc = cyc.join(on.select("node", F.lit(True).alias("ring")), "node", "left").withColumn("ring", F.coalesce("ring", F.lit(False)))
    return tree.unionByName(cyc.select("node", "parent", "comp", F.lit(-1).cast("long").alias("dist"), "ring"))


def _rings(batches):
    """mapInArrow over the at most MAX_RINGS nodes that lead into cycles: the smallest node of the cycle, and whether the node is on it."""
    parent: dict[int, int] = {}
    for b in batches:
        parent.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    comp: dict[int, int] = {}
    on: set[int] = set()
    for start in parent:
        trail, n, at = [], start, {}
        while n not in comp and n not in at:
            at[n] = len(trail)
            trail.append(n)
            n = parent[n]
        if n not in comp:
            on.update(trail[at[n] :])
        c = comp[n] if n in comp else min(trail[at[n] :])
        comp.update(dict.fromkeys(trail, c))
    cols = [list(parent), list(parent.values()), [comp[n] for n in parent], [n in on for n in parent]]
    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_())], names=["node", "parent", "comp", "ring"])


def _walk(rows: list[tuple[int, int | None, int]], paths: bool):
    """Iterative depth-first walk with colouring over whole components; rows: node, parent, component.

    Yields the columns of RESULT, a node when it is left; nothing but the trail is held for the paths.
    """
    kids: dict[int, list[int]] = {}
    parent: dict[int, int | None] = {}
    comp: dict[int, int] = {}
    for node, par, c in rows:
        parent[node], comp[node] = par, c
        if par is not None:
            kids.setdefault(par, []).append(node)
    white, grey, black = 0, 1, 2
    colour = dict.fromkeys(parent, white)
    for start in sorted(n for n, p in parent.items() if p is None):
        trail: list[int] = []
        below: list[int] = []
        stack = [(start, False)]
        while stack:
            node, leaving = stack.pop()
            if leaving:
                n = below.pop()
                yield node, parent[node], start, len(trail) - 1, False, comp[node], list(trail) if paths else None, n
                trail.pop()
                if below:
                    below[-1] += n + 1
                colour[node] = black
                continue
            colour[node] = grey
            trail.append(node)
            below.append(0)
            stack.append((node, True))
            stack.extend((k, False) for k in sorted(kids.get(node, ()), reverse=True))
    # what no root reaches hangs on a cycle; walk up until a grey node closes it
    for node in sorted(n for n, c in colour.items() if c == white):
        trail = []
        n = node
        while colour[n] == white:
            colour[n] = grey
            trail.append(n)
            n = parent[n]
        ring = set(trail[trail.index(n) :]) if colour[n] == grey else set()
        for m in trail:
            colour[m] = black
            yield m, parent[m], 0, -1, m in ring and parent[m] == comp[m], comp[m], [] if paths else None, -1


def _walk_partitions(paths: bool):
    """mapInArrow: partitions hold whole components, sorted; many of them are walked together."""
    names = [x.split()[0] for x in (RESULT if paths else PLAIN).split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.int64()][: len(names)]

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    def walked(kept):
        held, cells = [], 0
        for row in _walk(kept, paths):
            held.append(row)
            cells += len(row[6]) if paths else 0
            if len(held) >= HELD_ROWS or cells >= HELD_CELLS:
                yield batch(held)
                held, cells = [], 0
        if held:
            yield batch(held)

    def run(batches):
        kept: list[tuple] = []
        for b in batches:
            kept.extend(zip(*(b.column(i).to_pylist() for i in range(3))))
            if len(kept) > HELD_ROWS:
                last = kept[-1][2]
                cutoff = len(kept)
                while cutoff and kept[cutoff - 1][2] == last:
                    cutoff -= 1
                if cutoff:
                    yield from walked(kept[:cutoff])
                    kept = kept[cutoff:]
        if kept:
            yield from walked(kept)

    return run


def _large_rows(st: DataFrame, paths: bool) -> DataFrame:
    """The same rows for components that are too large to gather, all distributed; with ``paths`` by path doubling."""
    plain = [
        F.col("node").alias("node_id"),
        F.col("parent").alias("parent_id"),
        F.when(F.col("dist") < 0, F.lit(0).cast("long")).otherwise(F.col("comp")).alias("root_id"),
        F.col("dist").cast("int").alias("node_depth"),
        (F.col("ring") & (F.col("parent") == F.col("comp"))).alias("back_edge"),
        F.col("comp").alias("component"),
    ]
    if not paths:
        return st.select(*plain)
    cur = cut(st.filter("dist >= 0").withColumns({"up": F.col("parent"), "path": F.array("node")}), "paths")
    done, open_ = [cur.filter("up is null")], cur.filter("up is not null")
    while open_.limit(1).count():
        look = _union([*done, open_]).select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        new = cut(hot_join(open_, look, ["up"]).withColumns({"up": F.col("up2"), "path": F.concat("path2", "path")}).drop("up2", "path2"), "paths")
        done.append(new.filter("up is null"))
        open_ = new.filter("up is not null")
    trees = _union(done)
    below = trees.select(F.explode("path").alias("node")).groupBy("node").agg((F.count(F.lit(1)) - 1).alias("below"))
    trees = trees.join(below, "node").select(*plain, "path", F.col("below").alias("n_descendants"))
    return trees.unionByName(st.filter("dist < 0").select(*plain, F.array().cast("array<long>").alias("path"), F.lit(-1).cast("long").alias("n_descendants")))


def hierarchy(links: DataFrame, max_component: int = MAX_COMPONENT, paths: bool = True) -> DataFrame:
    """Per node of ``links`` (child, parent): node_id, parent_id, root_id, node_depth, back_edge, component; with ``paths`` also path (root to node) and n_descendants.

    Nodes on a cycle or leading into one have root_id 0, node_depth -1, an empty
    path and n_descendants -1; of each cycle the edge from one of its nodes to its
    smallest node is marked back_edge. Repeated links count once, NULLs are no
    links, of several parents the smallest counts, a link to itself is a cycle.
    Empty links give no rows. Without ``paths`` memory is bounded by the
    components gathered; with them the result itself is as long as the depths add
    up to, and is handed on in pieces.
    """
    st, n = cut_counted(components(links, max_component), "components", rows=F.count(F.lit(1)))
    small, large, n_large = st, None, 0
    if n["rows"] > max_component:
        sizes = st.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > max_component)
        large, found = cut_counted(sizes.select("comp", F.lit(True).alias("large")), "large", rows=F.count(F.lit(1)))
        n_large = found["rows"]
    if n_large:
        marked = cut(hot_join(st, large, ["comp"], total=n["rows"]), "marked")
        small = marked.filter("large is null")
    walked = small.select("node", "parent", "comp").repartition("comp").sortWithinPartitions("comp", "node").mapInArrow(_walk_partitions(paths), RESULT if paths else PLAIN)
    return walked if small is st else walked.unionByName(_large_rows(marked.filter("large").drop("large"), paths))


def descendants(tree: DataFrame) -> DataFrame:
    """All pairs ancestor_id, node_id, distance (1 or more), from the paths; as many rows as the depths add up to."""
    pairs = tree.filter("node_depth > 0").select("node_id", "node_depth", F.posexplode("path").alias("pos", "ancestor_id"))
    return pairs.filter("pos < node_depth").select("ancestor_id", "node_id", (F.col("node_depth") - F.col("pos")).alias("distance"))


def symbol_links(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """child, parent of the symbols: classes by ``inherits``, members by ``contains`` or else by parent_class.

    Edges whose ends are not both symbols do not count. A class or struct whose
    only link is a ``contains`` edge or a parent_class is taken as a member.
    """
    s = symbols.select("id", "repo", "file_path", "name", "kind", "parent_class")  # repeated rows give repeated links
    kind = F.coalesce(F.col("edge_kind"), F.substring_index("edge_type", ":", 1))
    e = edges.filter(kind.isin("inherits", "contains") & (F.col("source_id") != 0) & (F.col("target_id") != 0))
    inh = kind == "inherits"
    e = e.select(F.when(inh, F.col("source_id")).otherwise(F.col("target_id")).alias("child"), F.when(inh, F.col("target_id")).otherwise(F.col("source_id")).alias("parent"), inh.alias("inh"))
    e = cut(e.distinct(), "links")
    ids = s.select(F.col("id").alias("parent")).distinct().withColumn("p_ok", F.lit(True))
    e = hot_join(e, ids, ["parent"]).filter("p_ok").drop("p_ok")
    up = e.groupBy("child").agg(F.min(F.when(F.col("inh"), F.col("parent"))).alias("base"), F.min(F.when(~F.col("inh"), F.col("parent"))).alias("owner"))
    n = s.join(up, s["id"] == up["child"], "left").drop("child")
    is_class = F.col("kind").isin("class", "struct")
    direct = F.when(is_class, F.coalesce("base", "owner")).otherwise(F.col("owner"))
    n = cut(n.withColumn("direct", direct).select("id", "repo", "file_path", "kind", "parent_class", "direct"), "direct")
    named = s.filter(is_class).groupBy("repo", "file_path", F.col("name").alias("parent_class")).agg(F.min("id").alias("by_name"))
    rest = hot_join(n.filter("direct is null and parent_class is not null"), named, ["repo", "file_path", "parent_class"]).filter("by_name is not null and (by_name <> id or kind not in ('class', 'struct'))")
    return n.filter("direct is not null").select(F.col("id").alias("child"), F.col("direct").alias("parent")).unionByName(rest.select(F.col("id").alias("child"), F.col("by_name").alias("parent")))
