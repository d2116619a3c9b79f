"""Dependency graphs as edge frames (src, dst: string, kind optional): closure, components, cycles, weights, greedy cut.

Frontiers and labels stay distributed and are cut to the shared checkpoint folder; only counts come to the driver, but for
the greedy cut, which works on the few edges of the cycles that were found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declq.checkpoint import cut

#: Weight of an edge by its kind (fixed values), and what each further user of the target adds.
KIND_WEIGHTS = {"FIELD": 1.0, "SETTER": 2.0, "CONSTRUCTOR": 3.0, "BEAN_METHOD": 4.0}
IN_DEGREE_WEIGHT = 0.5
#: A round of the closure makes no more paths than so many an edge, or so many at all, before hubs are taken; a hub's bit is in a long.
PATHS_AN_EDGE, LEAST_PATHS, HUBS = 16, 100_000, 62
#: A hub that leaves more than this share of the paths is the last one of its round.
HUB_LEAVES = 0.75
#: Sources of a block of a hub, pairs of a task and tasks at most.
HUB_BLOCK, HUB_PAIRS, HUB_TASKS = 512, 1_000_000, 4_096


def reachable(edges: DataFrame, entry: DataFrame) -> DataFrame:
    """(node): entry points and all that can be reached from them. A frontier round joins edges once and drops known nodes."""
    pairs = edges.select("src", "dst").distinct()
    seen = cut(entry.select(F.col(entry.columns[0]).alias("node")).where("node is not null").distinct())
    frontier = seen
    while True:
        found = pairs.join(frontier, pairs.src == frontier.node).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)  # every frontier is written once and never again


def reachable_without(edges: DataFrame, entry: DataFrame, excluded: DataFrame) -> DataFrame:
    """The closure less the nodes of `excluded` (first column)."""
    return reachable(edges, entry).join(excluded.select(F.col(excluded.columns[0]).alias("node")), "node", "left_anti")


def _crowding(found: DataFrame, reach: int) -> tuple[float, str | None]:
    """How many paths the next round of the closure would make, and the node in the middle of most of them."""
    into = found.where(F.col("steps") == reach).groupBy(F.col("dst").alias("mid")).agg(F.count(F.lit(1)).cast("double").alias("n_in"))
    out = found.groupBy(F.col("src").alias("mid")).agg(F.count(F.lit(1)).cast("double").alias("n_out"))
    through = into.join(out, "mid").select("mid", (F.col("n_in") * F.col("n_out")).alias("paths"))
    row = through.agg(F.sum("paths").alias("paths"), F.max_by("mid", F.struct("paths", "mid")).alias("mid")).first()
    return row["paths"] or 0.0, row["mid"]


def _sides(pairs: DataFrame, found: DataFrame, hub: str, bit: int) -> tuple[DataFrame, bool]:
    """(node, up, down): nodes that reach the hub have its bit in `up`, those that it reaches in `down`; the hub has both.
    And whether the hub lies on a cycle. Found pairs are shortcuts: a step leads as far as they do."""
    near = pairs.unionByName(found.select("src", "dst"))
    steps = near.select("src", "dst", F.lit(False).alias("back")).unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back")))
    seen = cut(pairs.sparkSession.createDataFrame([(hub, False), (hub, True)], "node string, back boolean").coalesce(1))
    frontier = seen
    while True:
        on = steps.join(frontier.withColumnRenamed("node", "src"), ["src", "back"]).select(F.col("dst").alias("node"), "back").distinct()
        frontier = cut(on.join(seen, ["node", "back"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    side = lambda back: F.bit_or(F.when(F.col("back") == back, 1 << bit).otherwise(0).cast("long"))
    sides = cut(seen.groupBy("node").agg(side(True).alias("up"), side(False).alias("down")))
    last = pairs.where(F.col("dst") == hub).join(sides.where("down <> 0"), F.col("src") == F.col("node"), "left_semi")
    return sides, not last.isEmpty()


def _with_side(frame: DataFrame, sides: DataFrame | None, end: str, side: str) -> DataFrame:
    """`frame` with the bits of the node in column `end` as column `side`."""
    if sides is None:
        return frame.withColumn(side, F.lit(0).cast("long"))
    of = sides.select(F.col("node").alias(end), F.col(side).alias("_bits"))
    return frame.join(of, end, "left").withColumn(side, F.coalesce("_bits", F.lit(0).cast("long"))).drop("_bits")


def _through_hubs(sides: DataFrame, hubs: dict[str, bool]) -> DataFrame:
    """(src, dst): who reaches a hub with whom that hub reaches, each pair at its first hub only, so that no pair is shuffled.

    The sources of a hub are dealt over blocks of about HUB_BLOCK and its targets are copied to each block.
    """
    bits = lambda side: F.explode(F.expr(f"filter(sequence(0, {len(hubs) - 1}), i -> getbit({side}, i) = 1)")).alias("hub")
    sources = sides.where("up <> 0").select(F.col("node").alias("src"), "up", bits("up"))
    targets = sides.where("down <> 0").select(F.col("node").alias("dst"), "down", bits("down"))
    n_sources = sources.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / HUB_BLOCK).cast("long").alias("blocks"))
    sizes = cut(n_sources.join(targets.groupBy("hub").agg(F.count(F.lit(1)).alias("m")), "hub"))
    tasks = min(HUB_TASKS, int(sizes.agg(F.sum(F.col("n").cast("double") * F.col("m")) / HUB_PAIRS).first()[0]) + 1)
    blocks = sizes.select("hub", "blocks")
    dealt = sources.join(F.broadcast(blocks), "hub").withColumn("block", F.pmod(F.xxhash64("src"), "blocks")).drop("blocks").repartition(tasks, "hub", "block")
    copied = targets.join(F.broadcast(blocks), "hub").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks").repartition(tasks, "hub", "block")
    met = dealt.join(copied.hint("shuffle_hash"), ["hub", "block"]).where("up & down & (shiftleft(1L, hub) - 1L) = 0")
    alone = [hub for hub, cyclic in hubs.items() if not cyclic]
    return met.where((F.col("src") != F.col("dst")) | ~F.col("src").isin(alone)).select("src", "dst")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path of one edge or more. A round doubles the length up to which shortest paths are known.

    A shortest path of more than `reach` edges and at most twice as many has a node after `reach` edges, so pairs of just that
    length are led on by known pairs: there are few such nodes for a pair, and rounds grow with the logarithm of the longest path.

    Where a round would make many paths, the node in the middle of most of them becomes a hub: all that reach it are connected
    with all that it reaches, so these pairs are not found one by one; they are made at the end, from both sides. A shortest path
    between nodes that no hub connects has no part that a hub connects, so rounds need only the pairs that are left.
    The result has a row for every pair that is connected; where that is too many, ask `reachable` from some nodes instead.
    """
    # A null node begins or ends paths but leads none on: as a source and as a target it has two different names.
    pairs = cut(edges.select(F.coalesce(F.concat(F.lit("="), "src"), F.lit("<")).alias("src"), F.coalesce(F.concat(F.lit("="), "dst"), F.lit(">")).alias("dst")).distinct())
    most = max(LEAST_PATHS, PATHS_AN_EDGE * pairs.count())
    found, reach = pairs.withColumn("steps", F.lit(1)), 1
    hubs: dict[str, bool] = {}
    sides: DataFrame | None = None
    while True:
        paths, mid = _crowding(found, reach)
        while paths > most and mid is not None and len(hubs) < HUBS:
            own, hubs[mid] = _sides(pairs, found, mid, len(hubs))
            sides = own if sides is None else cut(sides.unionByName(own).groupBy("node").agg(F.bit_or("up").alias("up"), F.bit_or("down").alias("down")))
            found = cut(_with_side(_with_side(found, sides, "src", "up"), sides, "dst", "down").where("up & down = 0").select("src", "dst", "steps"))
            before, (paths, mid) = paths, _crowding(found, reach)
            if paths > HUB_LEAVES * before:  # no node is in the middle of many
                break
        ends = _with_side(found.where(F.col("steps") == reach).select("src", F.col("dst").alias("mid")), sides, "src", "up")
        on = _with_side(found.select(F.col("src").alias("mid"), "dst", (F.col("steps") + reach).alias("steps")), sides, "dst", "down")
        longer = ends.join(on, "mid").where("up & down = 0").groupBy("src", "dst").agg(F.min("steps").alias("steps"))
        last = cut(longer.join(found, ["src", "dst"], "left_anti"))
        if last.isEmpty():
            break
        found, reach = found.unionByName(last), 2 * reach  # every pair is written once
    out = found.select("src", "dst")
    if sides is not None:
        out = out.unionByName(_through_hubs(sides, hubs))
    return out.select(*[F.when(F.col(end).startswith("="), F.substring(end, 2, 2**31 - 1)).alias(end) for end in ("src", "dst")])


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that reaches it along `edges`, itself included."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    labels = cut(nodes.withColumn("label", F.col("node")))
    while True:
        sent = edges.join(labels, edges.src == labels.node).groupBy(F.col("dst").alias("at")).agg(F.min("label").alias("low"))
        low = cut(labels.join(sent, labels.node == sent["at"], "left").select("node", F.least("label", F.coalesce("low", "label")).alias("label"), (F.col("low") < F.col("label")).alias("moved")))
        labels = low.select("node", "label")
        if low.where("moved").isEmpty():
            return labels


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle: those that start where no edge ends, or end where none starts, go until none is left to go."""
    left, n = edges, edges.count()
    while True:
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = cut(inner.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = left.count()
        if now == n:
            return left
        n = now


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that it reaches and is reached from; nodes of no cycle are their own component.

    Each round labels nodes with the least node that reaches them; from a node that is its own label, those of its label that
    lead back to it are its component. Found components and all edges that cannot lie on a cycle go before the next round, so
    nothing grows with the number of paths.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    left = _trimmed(cut(edges.select("src", "dst").where("src <> dst").distinct()))
    found: DataFrame | None = None
    while not left.isEmpty():
        labels = _least_reaching(left)
        of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        inner = cut(left.join(of("src"), "src").join(of("dst"), "dst").where("src_label = dst_label").select("src", "dst", "src_label"))
        # Nodes of a label all come from its least node; those that lead back to it are the component.
        back = reachable(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), labels.where("node = label").select("node"))
        own = cut(labels.join(back, "node", "left_semi").select("node", F.col("label").alias("component")))
        found = own if found is None else found.unionByName(own)
        gone = own.select("node")
        rest = left.join(gone, left.src == gone.node, "left_anti").join(gone, F.col("dst") == gone.node, "left_anti")
        left = _trimmed(cut(rest))
    if found is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(component, size, nodes): strong components of more than one node; a self-loop alone is none."""
    groups = strong_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("node")).alias("nodes"))
    return groups.where("size > 1")


def has_cycles(edges: DataFrame) -> DataFrame:
    return cycle_groups(edges).agg((F.count(F.lit(1)) > 0).alias("has_cycles"), F.count(F.lit(1)).alias("n_groups"))


def elementary_cycles(edges: DataFrame) -> DataFrame:
    """(cycle): every elementary cycle of two nodes or more as an array that starts at its least node.

    Only edges inside a strong component are expanded, and a path never goes below its start, so each cycle is found once.
    Paths are simple, so no round is left after as many as the largest component has nodes.
    """
    comp = cut(strong_components(edges))
    a, b = comp.select(F.col("node").alias("src"), F.col("component").alias("ca")), comp.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    inner = cut(edges.select("src", "dst").where("src <> dst").distinct().join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"))
    paths = cut(inner.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("path")))
    found = None
    while not paths.isEmpty():
        step = paths.join(inner, paths.end == inner.src).where("dst >= start")
        closed = cut(step.where("dst = start").select(F.col("path").alias("cycle")))
        if not closed.isEmpty():
            found = closed if found is None else found.unionByName(closed)
        paths = cut(step.where("dst <> start").where(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("end"), F.concat("path", F.array("dst")).alias("path")))
    return found if found is not None else inner.select(F.array("src", "dst").alias("cycle")).where(F.lit(False))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))


def cycle_edges(cycles: DataFrame) -> DataFrame:
    """(cycle, src, dst): the edges of each cycle."""
    n = F.size("cycle")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("cycle", i).alias("src"), F.get("cycle", (i + 1) % n).alias("dst")))
    return cycles.select("cycle", F.explode(pairs).alias("e")).select("cycle", "e.src", "e.dst")


def edge_frequency(cycles: DataFrame) -> DataFrame:
    return cycle_edges(cycles).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_cycles"))


def edge_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, weight): the kind's weight and IN_DEGREE_WEIGHT for each edge into the target."""
    base = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in KIND_WEIGHTS.items()], F.lit(1.0))
    degrees = in_degrees(edges).withColumnRenamed("node", "target")
    return edges.join(degrees, edges.dst == degrees.target).select("src", "dst", "kind", (base + IN_DEGREE_WEIGHT * F.col("in_degree")).alias("weight"))


def dependency_edges(usages: DataFrame) -> DataFrame:
    """Edges of a bean graph from (src, dst, kind, lazy): lazy ones go, self edges only where a bean method makes them."""
    return usages.where(~F.coalesce("lazy", F.lit(False)) & ((F.col("src") != F.col("dst")) | (F.col("kind") == "BEAN_METHOD"))).select("src", "dst", "kind").distinct()


def greedy_cut(edges: DataFrame) -> DataFrame:
    """(step, src, dst): edges that break all cycles, at each step the one with most cycles per weight; ties by name.

    Each step is a grouped aggregate over the cycles that are left; one chosen edge a step comes to the driver.
    """
    weights = cut(edge_weights(edges).groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    left = cut(cycle_edges(elementary_cycles(edges)))
    chosen: list[tuple[int, str, str]] = []
    while True:
        ranked = left.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).join(weights, ["src", "dst"])
        best = ranked.orderBy((F.col("n") / F.col("weight")).desc(), "src", "dst").first()
        if best is None:
            return edges.sparkSession.createDataFrame(chosen, "step int, src string, dst string")
        chosen.append((len(chosen) + 1, best["src"], best["dst"]))
        hit = left.where((F.col("src") == best["src"]) & (F.col("dst") == best["dst"])).select("cycle")
        left = cut(left.join(hit, "cycle", "left_anti"))


def used_before_ready(usages: DataFrame, injected: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(bean, field, target): injected fields that a post-construct method uses; usages (bean, field), injected (bean, field, target).

    With the edges of the bean graph only beans that lie on a cycle count.
    """
    used = usages.join(injected, ["bean", "field"]).select("bean", "field", "target").distinct()
    if edges is None:
        return used
    groups = cycle_groups(edges).select(F.explode("nodes").alias("bean"))
    return used.join(groups, "bean", "left_semi")


def references_to(members: DataFrame, type_name: str) -> DataFrame:
    """Methods that refer to a type; members (method, kind, type)."""
    return members.where((F.col("kind") == "method") & (F.col("type") == type_name)).select("method").distinct()


def fields_used_by(uses: DataFrame, *methods: str) -> DataFrame:
    """(field, methods): the fields that the given methods (all, if none is given) use, and by which; uses (method, field)."""
    wanted = uses.where(F.col("method").isin(*methods)) if methods else uses
    return wanted.groupBy("field").agg(F.sort_array(F.collect_set("method")).alias("methods"))


def members_of(members: DataFrame, kind: str) -> DataFrame:
    """(name): all members of a kind, "field" or "method"; members (method, kind, type)."""
    return members.where(F.col("kind") == kind).select(F.col("method").alias("name")).distinct()


def signature(owner: Column, name: Column, parameters: Column) -> Column:
    """Key of a method node: Owner#name(Type,Type); of a field node (null parameters): Owner.name."""
    call = F.concat(owner, F.lit("#"), name, F.lit("("), F.array_join(parameters, ","), F.lit(")"))
    return F.when(parameters.isNull(), F.concat(owner, F.lit("."), name)).otherwise(call)


def subclasses(parents: DataFrame, root: str) -> DataFrame:
    """(node): all direct and indirect subtypes; parents (src = subtype, dst = supertype)."""
    down = parents.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    roots = parents.sparkSession.createDataFrame([(root,)], "node string")
    return reachable(down, roots).where(F.col("node") != root)
