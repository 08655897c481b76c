"""Graph algorithms that need a fixed point, as loops over frames.

Each round is joins and aggregations; its result is written to the shared
folder, which keeps plans short and survives the loss of executors.  A loop
ends when a round changes nothing.  Tops and cores grow or shrink towards a
bound in every round, so they end on any graph and have no cap of rounds;
other loops raise if their bound is reached first.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweft.operators.graph import half_edges, numbered_in_order, undirected, weighted
from tallyweft.storage import Bucketed, cut, cut_with


def until_still(start: DataFrame, step: Callable[[DataFrame], DataFrame], state: list[Column], rounds: int | None, what: str) -> DataFrame:
    """Apply ``step`` until ``state`` (aggregates that tell whether rows changed, taken as a round is written) stays the same."""
    now, was = cut_with(start, what, *state)
    for _ in count() if rounds is None else range(rounds):
        now, seen = cut_with(step(now), what, *state)
        if seen == was:
            return now
        was = seen
    raise RuntimeError(f"{what} did not settle in {rounds} rounds")


def _rows(*columns: str) -> list[Column]:
    """Number of the rows, and a hash of them if columns are named."""
    return [F.count(F.lit(1)), *([F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))] if columns else [])]


# --- components -------------------------------------------------------------------------------


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _star(pairs: DataFrame) -> DataFrame:
    """A large-star and a small-star round over pairs u > v."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least(both).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = _least(large)
    others = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(others).distinct()


def component_labels(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node on a pair (u, v); label is the least node it reaches.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), which
    need few rounds however long the paths are.  Null ends and loops are
    ignored; no pairs give an empty result.
    """
    clean = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    settled = until_still(clean, _star, _rows("u", "v"), rounds, "components")
    roots = settled.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return settled.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, size) of every vertex, over undirected edges; an isolated vertex is its own component."""
    labels = component_labels(undirected(edges).select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "id")
    named = cut(vertices.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component")), "components")
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return named.join(sizes, "component").select("id", "component", "size")


# --- strongly connected components ------------------------------------------------------------


def _peeled(pairs: DataFrame, layers: int = 2) -> DataFrame:
    """Without the edges of vertices that have no way in or no way out, some layers of them."""
    for _ in range(layers):
        sources, sinks = pairs.select(F.col("src").alias("x")).distinct(), pairs.select(F.col("dst").alias("x")).distinct()
        pairs = pairs.join(sinks, pairs["src"] == sinks["x"], "left_semi").join(sources, pairs["dst"] == sources["x"], "left_semi")
    return pairs


def _counted(pairs: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The rows, written, and their number."""
    rows, (n,) = cut_with(pairs, name, F.count(F.lit(1)))
    return rows, n


def _simple(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(id, number) of the ends of edges other than loops, numbered in an order that has nothing to do with the graph, and the distinct edges between the numbers with their count."""
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    ids = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("_h", F.struct(F.xxhash64("id"), "id"))
    names = cut(numbered_in_order(ids, "_h", "number").select("id", "number"), "numbers")
    at = lambda c: names.select(F.col("id").alias(c), F.col("number").alias(f"{c}_n"))
    return names, *_counted(pairs.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst")), "simple")


def _chained(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(id, first, last) of the vertices on chains that can go, and their number.

    A vertex with one edge in and one out lies on a chain.  Those that are not
    the highest of their neighbours on it go, so no cycle goes altogether, and
    runs of them are short.
    """
    out = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("last"))
    into = pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("first"))
    inner = out.where("n_out = 1").join(into.where("n_in = 1"), F.col("src") == F.col("dst")).select(F.col("src").alias("id"), "first", "last")
    return _counted(inner.where(~((F.col("id") > F.col("first")) & (F.col("id") > F.col("last")))), "chain")


def _shortened(pairs: DataFrame, heads: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """The pairs with chains drawn together and their number, and (id, first, last): the vertices gone and the ends that took their place.

    A vertex that has gone is of its ends' component if both ends are of one,
    and else on no cycle.
    """
    gone, left = heads, 1
    while left:  # runs double in length; a run ends at a vertex that stays
        far = gone.select(F.col("id").alias("last"), F.col("last").alias("_last"), F.lit(1).alias("_on"))
        back = gone.select(F.col("id").alias("first"), F.col("first").alias("_first"), F.lit(1).alias("_off"))
        step = gone.join(far, "last", "left").join(back, "first", "left")
        gone, (left,) = cut_with(step.select("id", F.coalesce("_first", "first").alias("first"), F.coalesce("_last", "last").alias("last"), F.coalesce("_on", "_off").alias("_on")), "chain", F.count("_on"))
        gone = gone.drop("_on")
    x = gone.select(F.col("id").alias("x"))
    kept = pairs.join(x, pairs["src"] == x["x"], "left_anti").join(x, pairs["dst"] == x["x"], "left_anti")
    # each run is one edge: that of its first vertex
    whole = heads.select("id", F.col("first").alias("_direct")).join(gone, "id").where("_direct = first and first <> last").select(F.col("first").alias("src"), F.col("last").alias("dst"))
    return *_counted(kept.unionByName(whole).distinct(), "shortened"), gone


def _highest(pairs: DataFrame, jumps: int = 2) -> DataFrame:
    """(id, top, low): the highest vertex that reaches each vertex, and the highest it reaches.

    What reaches a vertex's top reaches the vertex: so tops are also followed
    themselves, and the number of rounds does not grow with the diameter as
    vertices are numbered by chance.  Both ways are rows of one table.
    """
    way = lambda k, c, d: pairs.select(F.lit(k).alias("way"), F.col(c).alias("_from"), F.col(d).alias("id"))
    arcs = cut(way(0, "src", "dst").unionByName(way(1, "dst", "src")), "arcs")

    def step(t: DataFrame) -> DataFrame:
        sent = arcs.join(t.select("way", F.col("id").alias("_from"), "top"), ["way", "_from"]).select("way", "id", "top")
        near = t.unionByName(sent).groupBy("way", "id").agg(F.max("top").alias("top"))
        for _ in range(jumps):
            near = near.join(t.select("way", F.col("id").alias("top"), F.col("top").alias("_up")), ["way", "top"]).select("way", "id", F.col("_up").alias("top"))
        return near

    start = arcs.select("way", "id").distinct().unionByName(arcs.select("way", F.col("_from").alias("id")).distinct()).distinct()
    tops = until_still(start.select("way", "id", F.col("id").alias("top")), step, [F.sum(F.col("top").cast("decimal(38,0)"))], None, "top")
    return tops.groupBy("id").agg(F.max(F.when(F.col("way") == 0, F.col("top"))).alias("top"), F.max(F.when(F.col("way") == 1, F.col("top"))).alias("low"))


def strong_labels(edges: DataFrame, chains: float = 0.02) -> DataFrame:
    """(id, label) of the vertices that share a strong component with another vertex.

    Chains are drawn together first, as long as that takes a share of
    ``chains`` of the edges at least.  Then rounds: with the highest vertex
    that reaches each vertex and the highest it reaches, a vertex for which
    both are the same is of that one's component; edges between vertices that
    differ in either lie in no component, and go.  Each round splits what is
    left of a part at its highest vertex, as a sort by random pivots does
    (Coppersmith et al. 2003, Schudy 2008), so rounds grow with the logarithm.
    """
    spark = edges.sparkSession
    names, pairs, n = _simple(edges)
    levels = []
    while n:
        heads, held = _chained(pairs)
        if held < max(1, chains * n):
            break
        pairs, n, gone = _shortened(pairs, heads)
        levels.append(gone)
    found = spark.createDataFrame([], "id long, label long")
    pairs, n = _counted(_peeled(pairs), "inner")
    while n:
        both = cut(_highest(pairs), "both")
        found = found.unionByName(both.where("top = low").select("id", F.col("top").alias("label")))
        rest = both.where("top <> low")
        at = lambda c, rest=rest: rest.select(F.col("id").alias(c), F.col("top").alias(f"{c}_top"), F.col("low").alias(f"{c}_low"))
        pairs, n = _counted(_peeled(pairs.join(at("src"), "src").join(at("dst"), "dst").where("src_top = dst_top and src_low = dst_low").select("src", "dst")), "inner")
    for gone in reversed(levels):
        first, last = (found.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in ("first", "last"))
        ends = gone.join(first, "first", "left").join(last, "last", "left")
        first, last = F.coalesce("first_label", "first"), F.coalesce("last_label", "last")
        found = cut(found.unionByName(ends.where(first == last).select("id", first.alias("label"))), "strong")
    # a vertex may have lost all its neighbours to chains: its own label names it
    found = found.unionByName(found.select(F.col("label").alias("id"), "label")).distinct()
    shared = found.join(found.groupBy("label").count().where("count > 1").select("label"), "label")
    named = shared.join(names, shared["id"] == names["number"]).select(names["id"].alias("id"), "label")
    return cut(named, "labels")


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, size) of every vertex; a component is named by its largest vertex, a vertex on no cycle is its own."""
    labels = strong_labels(edges)
    top = labels.groupBy("label").agg(F.max("id").alias("component"))
    found = labels.join(top, "label").select("id", "component")
    named = vertices.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return named.join(sizes, "component").select("id", "component", "size")


# --- PageRank, cores --------------------------------------------------------------------------


def pagerank(vertices: DataFrame, edges: DataFrame, *, damping: float = 0.85, tol: float = 1e-6, rounds: int = 100, fixed: int | None = None) -> DataFrame:
    """(id, pagerank) on the simple directed graph weighted by parallel edges; dangling mass is shared evenly.

    Ends when the summed change falls below tol times the vertices, or after
    exactly ``fixed`` rounds; raises if neither happens within ``rounds``.
    """
    v = vertices.select("id").distinct()
    with Bucketed(v.sparkSession) as tables:
        w = weighted(edges)
        out = w.groupBy("src").agg(F.sum("weight").alias("total"))
        links = tables.cut(w.join(out, "src").select("src", F.col("dst").alias("id"), (F.col("weight") / F.col("total")).alias("share")), "src", "links")
        sinks = v.join(links.select(F.col("src").alias("id")).distinct().withColumn("_out", F.lit(True)), "id", "left")
        now = tables.cut(sinks.select("id", F.col("_out").isNull().alias("sink"), F.lit(None).cast("double").alias("was"), F.lit(None).cast("double").alias("pagerank")), "id", "ranks")
        n = now.count()
        start = F.coalesce("pagerank", F.lit(1.0 / n if n else 0.0))
        for _ in range(fixed or rounds):
            # links lie by source and ranks by vertex in the same buckets: what is sent is the one exchange of a round
            ranks = now.select("id", "sink", start.alias("pagerank"))
            lost = ranks.where("sink").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0))).first()[0]
            sent = links.join(ranks.select(F.col("id").alias("src"), "pagerank"), "src").groupBy("id").agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
            new = F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n if n else 0.0)) + F.lit((1 - damping) / n if n else 0.0)
            step = ranks.join(sent, "id", "left").select("id", "sink", F.col("pagerank").alias("was"), new.alias("pagerank"))
            now = tables.cut(step, "id", "ranks")
            if fixed is None and (now.agg(F.sum(F.abs(F.col("pagerank") - F.col("was")))).first()[0] or 0.0) < n * tol:
                break
        else:
            if fixed is None and n:
                raise RuntimeError(f"pagerank did not settle in {rounds} rounds")
        return cut(now.select("id", start.alias("pagerank")), "pagerank")


def core_numbers(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, core) by repeated h-indices of the neighbours' values (Lue et al. 2016), from the degrees down."""
    with Bucketed(vertices.sparkSession) as tables:
        near = tables.cut(half_edges(edges).select("id", "other"), "other", "near")
        now = tables.cut(near.groupBy("id").agg(F.count(F.lit(1)).alias("core")), "id", "cores")
        was, total = None, now.agg(F.sum("core")).first()[0]
        while total != was:
            # neighbours' values meet the links in their buckets; the ranks by vertex are the one exchange of a round
            seen = near.join(now.select(F.col("id").alias("other"), F.col("core").alias("theirs")), "other")
            # ranks within a vertex by window, so a hot vertex sorts and spills instead of holding an array
            place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("theirs")))
            h = seen.withColumn("place", place).groupBy("id").agg(F.max(F.least("theirs", F.col("place").cast("long"))).alias("h"))
            now = tables.cut(now.join(h, "id").select("id", F.least("core", "h").alias("core")), "id", "cores")
            was, total = total, now.agg(F.sum("core")).first()[0]
        settled = cut(now, "cores")
    return vertices.select("id").distinct().join(settled, "id", "left").na.fill(0, ["core"])


# --- neighbourhoods ---------------------------------------------------------------------------


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, depth): what lies within ``hops`` undirected steps of ``seeds(id)``, with its least depth."""
    near = half_edges(edges)
    reached = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "reached")
    for depth in range(1, hops + 1):
        edge = reached.where(F.col("depth") == depth - 1).select("id")
        new = near.join(edge, "id").select(F.col("other").alias("id")).distinct().join(reached, "id", "left_anti")
        reached = cut(reached.unionByName(new.withColumn("depth", F.lit(depth))), "reached")
    return reached


def effective_fanout(fanout: list[int], layers: int) -> list[int]:
    """As many entries as layers: cut, or the last repeated; 10 where none is given."""
    base = list(fanout) or [10]
    return (base + base[-1:] * layers)[:layers]


def sample_neighbourhood(edges: DataFrame, seeds: DataFrame, fanout: list[int], seed: int = 0) -> DataFrame:
    """(hop, tx_id, src, dst): at each hop, at most fanout incoming edges of each frontier vertex.

    The choice is by the order of a keyed MD5, the same on every run; parallel
    edges are edges of their own.
    """
    frontier, out = seeds.select("id").distinct(), None
    for hop, most in enumerate(fanout):
        order = F.md5(F.concat_ws(":", F.col("tx_id").cast("string"), F.lit(str(seed)), F.lit(str(hop))))
        turn = F.row_number().over(W.partitionBy("dst").orderBy(order, "tx_id"))
        near = edges.join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi")
        picked = cut(near.withColumn("turn", turn).where(F.col("turn") <= most).select(F.lit(hop).alias("hop"), "tx_id", "src", "dst"), "picked")
        out = picked if out is None else out.unionByName(picked)
        frontier = picked.select(F.col("src").alias("id")).distinct()
    return out


def has_cycle(vertices: DataFrame, edges: DataFrame) -> bool:
    """Whether any directed cycle exists, a loop included."""
    return not edges.where("src = dst").isEmpty() or not strong_labels(edges).isEmpty()


def laundering_rings(edges: DataFrame, positive: str = "laundering") -> DataFrame:
    """(ring_id, member) of the components of the edges with that label; a ring's id is its least member."""
    e = edges.where(F.col("label") == positive)
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return connected_components(ends, e).select(F.col("component").alias("ring_id"), F.col("id").alias("member"))
