"""Parent links to full hierarchies by heavy-path decomposition, and loops of directed graphs.

Up: pointer doubling separates trees from loops and yields subtree sizes; every node keeps one heavy child (the largest
subtree, ties to the largest id), so nodes fall into chains and any root path crosses at most log2(n) of them. A node's
path is the concatenation of chain prefixes, its descendants are one interval of a heavy-first preorder. All steps take
O(log depth) rounds over the nodes that are not finished yet, each a few equi-joins on unique keys, cut by a written table.

Down: nodes that lead back to themselves are the strongly connected components of the child graph. A sweep labels every
node with the least (in a random order of the ids) of all that reach it, then, within equal labels, with the least of all
it reaches; nodes with both labels equal are one component, and edges between different labels are on no loop. Labels
spread along edges and by following the label of the label, so a sweep takes a number of rounds logarithmic in the length
of loops and paths, and expected logarithmically many sweeps settle all. A residue under ``RESIDUE_EDGES`` edges is
finished in one task instead, with the same result.

Defined results: a null id is no node; of repeated states the latest counts (ties: the largest row; a null time is the
oldest); a pointer that is null, empty or names no node ends the path; a node that points to itself is a loop of one;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from nodeloom.runtime import Scratch, count_where, table

#: Edges that one task may hold when the loops of the child graph are finished (about 40 MB in Python).
RESIDUE_EDGES = 200_000
#: Rows of one sibling bucket in distributed prefix sums.
BUCKET_ROWS = 1_000_000
#: Nodes of one block of a chain, copies of what many rows look up, and the widest block of the preorder (a power of two).
CHAIN_BLOCK, SALTS, RANGE_BLOCK = 64, 8, 16


def latest_states(docs: DataFrame, *pointers: str, key: str = "id", at: str = "updated_at") -> DataFrame:
    """One row per ``key`` with the pointers of its latest state."""
    d = docs.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.struct(at, *pointers)).alias("s"))
    return d.select("id", *[F.col(f"s.{p}").alias(p) for p in pointers])


def existing_parents(nodes: DataFrame) -> DataFrame:
    """(id, parent) with parents that are null, empty or unknown turned into null."""
    real = F.col("parent").isNotNull() & (F.col("parent") != "")
    known = nodes.filter(real).join(nodes.select(F.col("id").alias("_k")), F.col("parent") == F.col("_k"), "left").select("id", F.col("_k").alias("parent"))
    return known.unionByName(nodes.filter(~F.coalesce(real, F.lit(False))).select("id", F.lit(None).cast("string").alias("parent")))


def prefix_sum(df: DataFrame, group: str, order: str, value: str, rows: int) -> DataFrame:
    """``before``: the sum of ``value`` over the rows of the group that come earlier, in an order fixed by (hash, order).

    Groups of any size are spread over buckets, so no task sorts a whole group."""
    n = max(1, math.ceil(rows / BUCKET_ROWS))
    b = df.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(n)))
    sums = b.groupBy(group, "_b").agg(F.sum(value).alias("_s"))
    ahead = W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(group, "_b", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_base"))
    within = W.partitionBy(group, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return b.join(sums, [group, "_b"]).withColumn("before", F.col("_base") + F.col("_in")).drop("_b", "_in", "_base")


def _double(act: DataFrame, of: DataFrame, *extra: Column) -> DataFrame:
    """Active rows with their jump followed once more; ``of`` has one row per id."""
    t = of.select(F.col("id").alias("_k"), *[F.col(c).alias(f"_{c}") for c in of.columns if c != "id"])
    return act.join(t, act.jump == t._k).select("id", F.col("_jump").alias("jump"), *extra)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _separate(s: Scratch, nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(tree, act): the nodes (id, parent, size) of trees with the sizes of their subtrees, where ``nodes`` (id, parent, own)
    count ``own`` each; (id, jump) of those that reach a loop, if any.

    A round's table holds the rows still on their way, (id, jump, size) with jump 2^k steps up and size of the subtree
    down to there, and what they gave to the node at their jump: (id, null, given)."""
    act = nodes.filter(F.col("parent").isNotNull()).select("id", F.col("parent").alias("jump"), F.col("own").alias("size"))
    given, active, act_at = [], None, act
    while True:
        gives = act_at.groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("add"))
        moved = _double(act_at, act_at.select("id", "jump"), F.col("size")).join(gives, "id", "left")
        moved = moved.select("id", "jump", (F.col("size") + F.coalesce("add", F.lit(0))).alias("size"))
        log = gives.select("id", F.lit(None).cast("string").alias("jump"), F.col("add").alias("size"))
        t, c = s.cut(moved.unionByName(log), active=F.count("jump"))
        given.append(t.filter(F.col("jump").isNull()).select("id", "size"))
        act_at, before, active = t.filter(F.col("jump").isNotNull()), active, c["active"]
        if not active or active == before:
            break
    sizes = _union(given).groupBy("id").agg(F.sum("size").alias("size"))
    tree = nodes.join(act_at.select("id"), "id", "left_anti") if active else nodes
    tree = tree.join(sizes, "id", "left").select("id", "parent", (F.coalesce("size", F.lit(0)) + F.col("own")).alias("size"))
    return s.cut(tree)[0], (act_at.select("id", "jump") if active else None)


def _loops(s: Scratch, nodes: DataFrame, act: DataFrame) -> DataFrame:
    """(id, root_id, depth -1 or -2) of the nodes of ``act`` (id, jump), all on a loop or leading into one."""
    act, _ = s.cut(act)
    on, c = s.cut(act.select(F.col("jump").alias("id")).distinct(), n=F.count(F.lit(1)))
    while True:
        nxt, _ = s.cut(_double(act, act))
        again, d = s.cut(nxt.select(F.col("jump").alias("id")).distinct(), n=F.count(F.lit(1)))
        s.drop(act, on)
        act, on, c, same = nxt, again, d, d["n"] == c["n"]
        if same:
            break
    ring, _ = s.cut(nodes.join(on, "id", "left_semi").select("id", F.col("parent").alias("jump"), F.col("id").alias("low"), F.lit(True).alias("ch")))
    while True:
        t = ring.select(F.col("id").alias("_k"), F.col("jump").alias("_jump"), F.col("low").alias("_low"))
        nxt = ring.join(t, ring.jump == t._k).select("id", F.col("_jump").alias("jump"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("ch"))
        nxt, c = s.cut(nxt, ch=count_where(F.col("ch")))
        s.drop(ring)
        ring = nxt
        if not c["ch"]:
            break
    low = ring.select(F.col("id").alias("jump"), F.col("low").alias("root_id"))
    own = ring.select(F.col("id").alias("id"), F.col("low").alias("root_id"), F.lit(-1).alias("depth"))
    into = act.join(on, "id", "left_anti").join(low, "jump").select("id", "root_id", F.lit(-2).alias("depth"))
    return own.unionByName(into)


def _follow(s: Scratch, start: DataFrame, step) -> DataFrame:
    """Follow the jumps of ``start`` (id, jump, done, ...) until all are done, doubling the step every round.

    step(act, of): the active rows moved on by the rows at their jump. A round writes active rows only."""
    t, c = s.cut(start, left=count_where(~F.col("done")))
    done = [t.filter("done")]
    while c["left"]:
        act = t.filter(~F.col("done"))
        t, c = s.cut(step(act, _union([*done, act])), left=count_where(~F.col("done")))
        done.append(t.filter("done"))
    return _union(done)


def _chains(s: Scratch, tree: DataFrame, leaves: DataFrame, n: int) -> DataFrame:
    """Root, depth, chain, position in it, path segments and preorder interval of the nodes of trees: ``tree`` (id, parent,
    size) those with children, ``leaves`` (id, parent) the others, which take theirs from their parents at the end."""
    one = F.lit(1).cast("bigint")
    kids = tree.filter(F.col("parent").isNotNull()).withColumn("leaf", F.lit(False)).unionByName(leaves.filter(F.col("parent").isNotNull()).select("id", "parent", one.alias("size"), F.lit(True).alias("leaf")))
    heavy, _ = s.cut(kids.groupBy("parent").agg(F.max(F.struct("size", "id")).alias("h")).select(F.col("h.id").alias("id"), F.col("h.size").alias("hsize"), F.col("parent").alias("hp")))
    link = tree.join(heavy.select("id", F.lit(True).alias("heavy")), "id", "left")
    is_heavy = F.coalesce(F.col("heavy"), F.lit(False))
    start = link.select("id", F.when(is_heavy, F.col("parent")).otherwise(F.col("id")).alias("jump"), F.when(is_heavy, 1).otherwise(0).cast("bigint").alias("pos"), "size", (~is_heavy).alias("done"))
    run = _follow(s, start, lambda act, of: _double(act, of.select("id", "jump", "pos", "done"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("size"), F.col("_done").alias("done")))
    run = run.select("id", F.col("jump").alias("chain"), "pos", "size")
    # every light child with the preorder offset from its parent: behind the heavy child and the light ones before it
    light = kids.join(heavy.select("id"), "id", "left_anti")
    light = prefix_sum(light.select("id", "parent", "size", "leaf"), "parent", "id", "size", n)
    light = light.join(heavy.select(F.col("hp").alias("parent"), "hsize"), "parent")
    light, _ = s.cut(light.select("id", "parent", "leaf", (1 + F.col("hsize") + F.col("before")).alias("offset")))
    # every head of a chain with the place where its chain hangs
    hang = light.filter(~F.col("leaf")).join(run.select(F.col("id").alias("parent"), F.col("chain").alias("up"), F.col("pos").alias("up_pos")), "parent")
    seg = F.array(F.struct(F.col("up").alias("chain"), F.col("up_pos").alias("upto")))
    hang = hang.select("id", F.col("up").alias("jump"), (F.col("up_pos") + 1).alias("d"), (F.col("up_pos") + F.col("offset")).alias("tin"), seg.alias("segs"))
    kind = dict(hang.dtypes)["segs"]
    none, zero = F.array().cast(kind), F.lit(0).cast("bigint")
    tops = tree.filter(F.col("parent").isNull()).select("id", F.col("id").alias("jump"), zero.alias("d"), zero.alias("tin"), none.alias("segs"), F.lit(True).alias("done"))
    heads = _follow(s, hang.withColumn("done", F.lit(False)).unionByName(tops), lambda act, of: _double(
        act, of, (F.col("d") + F.col("_d")).alias("d"), (F.col("tin") + F.col("_tin")).alias("tin"), F.concat("_segs", "segs").alias("segs"), F.col("_done").alias("done")))
    heads = heads.select(F.col("id").alias("chain"), F.col("jump").alias("root_id"), "d", "tin", "segs")
    inner = run.join(heads, "chain")
    inner = inner.select("id", "root_id", (F.col("d") + F.col("pos")).cast("int").alias("depth"), "chain", "pos", "segs", (F.col("tin") + F.col("pos")).alias("tin"), "size")
    inner, _ = s.cut(inner)
    up = inner.select(F.col("id").alias("parent"), "root_id", "depth", F.col("chain").alias("_c"), F.col("pos").alias("_p"), "segs", "tin")
    hung = leaves.join(light.filter("leaf").select("id", "offset"), "id", "left").join(up, "parent")
    own = F.col("offset").isNotNull()  # else the heavy child
    hung = hung.select("id", "root_id", (F.col("depth") + 1).alias("depth"), F.when(own, F.col("id")).otherwise(F.col("_c")).alias("chain"), F.when(own, zero).otherwise(F.col("_p") + 1).alias("pos"),
                       F.when(own, F.concat("segs", F.array(F.struct(F.col("_c").alias("chain"), F.col("_p").alias("upto"))))).otherwise(F.col("segs")).alias("segs"),
                       (F.col("tin") + F.coalesce("offset", one)).alias("tin"), one.alias("size"))
    lone = leaves.filter(F.col("parent").isNull()).select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.col("id").alias("chain"), zero.alias("pos"), none.alias("segs"), zero.alias("tin"), one.alias("size"))
    return inner.unionByName(hung).unionByName(lone)


HIERARCHY = ("id", "root_id", "depth", "chain", "pos", "segs", "tin", "size")


def hierarchy(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """All nodes of (id, parent), one row per id, with the columns ``HIERARCHY``.

    depth: steps to the root, -1 on a loop, -2 leading into one (root_id is then the loop's smallest id and the columns
    after depth are null). Path: chain prefixes ``segs`` (chain, upto), then ``chain`` up to ``pos``. Descendants and the
    node itself: the nodes of the same root with ``tin`` in [tin, tin + size)."""
    s = Scratch(spark, "hierarchy")
    base = existing_parents(nodes)
    above = base.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("id")).distinct().withColumn("_up", F.lit(True))
    base, c = s.cut(base.join(above, "id", "left").select("id", "parent", F.col("_up").isNull().alias("leaf")), n=F.count(F.lit(1)))
    # leaves, often most nodes, stay out of the rounds: they count for their parents
    leaves, inner = base.filter("leaf").select("id", "parent"), base.filter("NOT leaf").select("id", "parent")
    few = leaves.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    inner, _ = s.cut(inner.join(few, "id", "left").select("id", "parent", (F.coalesce("k", F.lit(0)) + 1).alias("own")))
    tree, cyclic = _separate(s, inner)
    out = _chains(s, tree, leaves, c["n"])
    if cyclic is not None:
        loops, _ = s.cut(_loops(s, inner.select("id", "parent"), cyclic))
        below = leaves.join(loops.select(F.col("id").alias("parent"), "root_id"), "parent").select("id", "root_id", F.lit(-2).alias("depth"))
        types = dict(out.dtypes)
        out = out.unionByName(loops.unionByName(below).select("id", "root_id", "depth", *[F.lit(None).cast(types[c]).alias(c) for c in HIERARCHY[3:]]))
    return out


def full_paths(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, path): the ids from the root down to each asked node, concatenated from prefixes of chains.

    Chains are cut into blocks of ``CHAIN_BLOCK`` nodes, which are joined by their number: nothing is read that is on no
    path, and a block that many paths pass is spread over ``SALTS`` copies. A path is as long as its node is deep."""
    own = tree.join(ids.select("id"), "id", "left_semi").filter(F.col("depth") >= 0)
    segs = own.select("id", F.posexplode(F.concat("segs", F.array(F.struct("chain", F.col("pos").alias("upto"))))).alias("at", "g"))
    last = F.floor(F.col("g.upto") / CHAIN_BLOCK)
    segs = segs.select("id", "at", F.col("g.chain").alias("chain"), F.col("g.upto").alias("upto"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("blk"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    blocks = tree.filter(F.col("depth") >= 0).groupBy("chain", F.floor(F.col("pos") / CHAIN_BLOCK).alias("blk")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("id").alias("step")))).alias("b"))
    blocks = blocks.select("chain", "blk", F.col("b.step").alias("steps"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    part = F.slice("steps", 1, F.least(F.lit(CHAIN_BLOCK), F.col("upto") - F.col("blk") * CHAIN_BLOCK + 1).cast("int"))
    hit = segs.join(blocks, ["chain", "blk", "salt"]).select("id", F.struct("at", "blk", part.alias("steps")).alias("p"))
    return hit.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("p")).select("id", F.flatten(F.col("p.steps")).alias("path"))


def descendants(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, descendant) of each asked node, by its preorder interval.

    Intervals meet the nodes in blocks of the preorder about as wide as they are, at most ``RANGE_BLOCK``: so few nodes
    are looked at that are no descendants (at most three for each that is), and no block is a hot key."""
    q = tree.join(ids.select("id"), "id", "left_semi").filter(F.col("size") > 1)
    q = q.select("id", "root_id", (F.col("tin") + 1).alias("a"), (F.col("tin") + F.col("size")).alias("b"), F.least(F.ceil(F.log2(F.col("size").cast("double"))), F.lit(RANGE_BLOCK)).cast("int").alias("w"))
    q = q.withColumn("blk", F.explode(F.sequence(F.expr("shiftright(a, w)"), F.expr("shiftright(b - 1, w)"))))
    t = tree.filter(F.col("depth") > 0).select(F.col("id").alias("descendant"), "root_id", "tin")
    t = t.join(q.groupBy("root_id").agg(F.collect_set("w").alias("ws")), "root_id").withColumn("w", F.explode("ws")).withColumn("blk", F.expr("shiftright(tin, w)")).drop("ws")
    return q.join(t, ["root_id", "w", "blk"]).filter((F.col("tin") >= F.col("a")) & (F.col("tin") < F.col("b"))).select("id", "descendant")


# -- loops of a general directed graph ---------------------------------------------------------------------------------


def _trim(s: Scratch, edges: DataFrame, n: int, most: int) -> tuple[DataFrame, int]:
    """Written edges without those that no loop can use, as long as a round of two semi-joins removes a fifth of them and
    more than ``most`` are left; long paths are left to the sweeps."""
    while n > most:
        t = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        t = t.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        t, c = s.cut(t, n=F.count(F.lit(1)))
        s.drop(edges)
        edges, before, n = t, n, c["n"]
        if n > 0.8 * before:
            break
    return edges, n


_PAIR = T.StructType([T.StructField("id", T.StringType()), T.StructField("root_id", T.StringType())])


def _components(batches):
    """Strongly connected components with a loop, of all edges of this one task (iterative depth-first search)."""
    out: dict[str, list[str]] = {}
    loops: set[str] = set()
    for b in batches:
        for a, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            out.setdefault(a, []).append(z)
            if a == z:
                loops.add(a)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: set[str] = set()
    stack: list[str] = []
    ids, roots = [], []
    for start in out:
        if start in index:
            continue
        todo = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        open_.add(start)
        while todo:
            v, it = todo[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    open_.add(w)
                    todo.append((w, iter(out.get(w, ()))))
                    break
                if w in open_:
                    low[v] = min(low[v], index[w])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        open_.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1 or v in loops:
                        ids += part
                        roots += [min(part)] * len(part)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(roots, pa.string())], names=["id", "root_id"])


def _spread(s: Scratch, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, c): for each id the least, by (hash, id), of all ids that reach it over edges (src, dst), itself included.

    Every round takes the least label of the nodes before and then the label of the node it names, which reaches whatever
    the label's node reaches."""
    col, _ = s.cut(ids.select("id", F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("k")).alias("c"), F.lit(True).alias("ch")))
    while True:
        best = edges.join(col.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
        near = col.join(best, "id", "left").select("id", "c", F.least("c", "m").alias("m"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
        own = col.filter(F.col("c.k") != F.col("id")).select(F.col("id").alias("_k"), F.col("c").alias("_c"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_s"))
        far = near.join(own, (F.col("m.k") == F.col("_k")) & (F.col("salt") == F.col("_s")), "left")
        nxt, d = s.cut(far.select("id", F.least("m", "_c").alias("c"), (F.least("m", "_c") < F.col("c")).alias("ch")), ch=count_where(F.col("ch")))
        s.drop(col)
        col = nxt
        if not d["ch"]:
            return col.select("id", "c")


def _between(edges: DataFrame, col: DataFrame) -> DataFrame:
    """The edges whose ends have the same label in (id, c), with it."""
    e = edges.join(col.select(F.col("id").alias("src"), "c"), "src").join(col.select(F.col("id").alias("dst"), F.col("c").alias("c2")), "dst")
    return e.filter(F.col("c") == F.col("c2")).select("src", "dst", "c")


def _sweep(s: Scratch, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled, rest) of written edges: (id, root_id) on the loops that this sweep settles, and the edges others may use."""
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    fwd = _spread(s, edges, ids)
    same, _ = s.cut(_between(edges, fwd))
    bwd = _spread(s, same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ids)
    both, _ = s.cut(fwd.join(bwd.withColumnRenamed("c", "b"), "id"))
    comp = both.filter(F.col("c") == F.col("b")).select("id", F.col("c.k").alias("c"))
    own = same.filter("src = dst").select(F.col("src").alias("c")).distinct().withColumn("own", F.lit(True))
    roots = comp.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("root_id")).join(own, "c", "left").filter((F.col("k") > 1) | F.col("own"))
    open_ = both.filter(F.col("c") != F.col("b")).select("id", F.col("b").alias("c"))
    return comp.join(roots.select("c", "root_id"), "c").select("id", "root_id"), _between(same.select("src", "dst"), open_).select("src", "dst")


def loop_members(spark: SparkSession, edges: DataFrame, residue: int = RESIDUE_EDGES) -> DataFrame:
    """(id, root_id) of every node of (src, dst) that leads back to itself; root_id is the smallest id of its component."""
    s = Scratch(spark, "loops")
    e, c = s.cut(edges.select("src", "dst").distinct(), n=F.count(F.lit(1)))
    n, found = c["n"], []
    while True:
        e, n = _trim(s, e, n, residue)
        if n <= residue:
            return _union([*found, e.coalesce(1).mapInArrow(_components, _PAIR)])
        settled, rest = _sweep(s, e)
        found.append(s.cut(settled)[0])
        nxt, c = s.cut(rest, n=F.count(F.lit(1)))
        s.drop(e)
        e, n = nxt, c["n"]
        if not n:
            return _union(found)


def child_edges(states: DataFrame) -> DataFrame:
    """(src, dst) from each node to the children it names, as far as they exist."""
    e = states.select(F.col("id").alias("src"), F.explode(F.array("cm1_id", "cm2_id")).alias("dst"))
    e = e.filter(F.col("dst").isNotNull() & (F.col("dst") != ""))
    return e.join(states.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def graph_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p5_found``: root and depth of every document upwards, and the documents on loops of child pointers."""
    states, _ = Scratch(spark, "states").cut(latest_states(table(spark, sf_dir, "graph_docs"), "parent_edge_id", "cm1_id", "cm2_id"))
    up = hierarchy(spark, states.select("id", F.col("parent_edge_id").alias("parent")))
    down = loop_members(spark, child_edges(states))
    return up.select(F.lit("up").alias("link"), "id", "root_id", "depth").unionByName(
        down.select(F.lit("down").alias("link"), "id", "root_id", F.lit(-1).alias("depth"))
    )


def graph_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p5_loops``: the documents on loops of child pointers, by sweeps down to the last edge, none left to a task."""
    return loop_members(spark, child_edges(latest_states(table(spark, sf_dir, "graph_docs"), "cm1_id", "cm2_id")), 0)


def graph_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy of the documents' parents, written once as several passes read it."""
    up = hierarchy(spark, latest_states(table(spark, sf_dir, "graph_docs"), "parent_edge_id").withColumnRenamed("parent_edge_id", "parent"))
    return Scratch(spark, "tree").cut(up)[0]


def graph_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p5_paths``: every document's root, depth and number of descendants, and its path as chain segments."""
    up = hierarchy(spark, latest_states(table(spark, sf_dir, "graph_docs"), "parent_edge_id").withColumnRenamed("parent_edge_id", "parent"))
    return up.select("id", "root_id", "depth", "chain", "pos", F.to_json("segs").alias("segments"), (F.col("size") - 1).alias("descendants"))


def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p5_full_paths``: the whole path of every document that is not on a loop and leads into none, from its root down."""
    t = graph_tree(spark, sf_dir)
    return full_paths(t, t).select("id", F.array_join("path", "/").alias("path"))


def graph_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p5_descendants``: all descendants of every document."""
    t = graph_tree(spark, sf_dir)
    return descendants(t, t)
