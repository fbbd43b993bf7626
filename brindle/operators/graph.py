"""Undirected graphs as edge tables, and counting of small patterns (motifs) in them.

A pattern's ordered embeddings are counted without induction: extra edges between the matched
vertices are allowed. Counting goes by what a pattern allows:

* stars from degrees alone; paths of four from the degrees at each edge, less the triangles;
* cliques over edges that point from lower to higher (degree, id), so that no hub pairs up its
  neighbours; tailed triangles from the degrees at the corners of triangles, diamonds from the
  number of triangles on each edge;
* squares and five-cycles from their highest vertex, through two-paths of lower vertices, of which
  there are no more than the lower ends' degrees add up to; five-cycles are pairs of such paths whose
  ends are an edge, less the pairs that share a vertex, which triangles and degrees tell; houses are
  the triangles on the edges of squares, less those that diamonds account for;
* any other pattern one vertex at a time from intersected neighbour lists, parts of it that aren't
  connected by products of counts (``patterns``).

Raw counts are instances times automorphisms.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.scratch import Scratch, shared_dir, written
from brindle.operators import patterns
from brindle.operators.ordering import numbered
from brindle.operators.motifs import MOTIFS, Motif, motif, pattern

__all__ = ["MOTIFS", "Motif", "motif", "pattern"]

#: Neighbour ids that one block of a neighbour list spans.
BLOCK = 1024


def normalize(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, without loops and repeats."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(vertex, block, neighbours, n): each vertex's neighbours in ascending order, in blocks of ids
    that bound the lists, so that a hub has many rows and not one long one."""
    found = edges.groupBy(F.col("src").alias("vertex"), F.expr(f"dst div {block}").alias("block"))
    return found.agg(F.sort_array(F.collect_list("dst")).alias("neighbours"), F.count("*").alias("n"))


def has_edge(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(src, dst) + linked: whether the graph has that edge."""
    return pairs.join(edges.select("src", "dst").withColumn("_there", F.lit(True)), ["src", "dst"], "left").withColumn("linked", F.coalesce("_there", F.lit(False))).drop("_there")


def embeddings(edges: DataFrame, m: Motif, ordered: bool = False) -> DataFrame:
    """v0..vk of every instance of a connected pattern (of every ordered embedding, if ordered).
    Written to the shared folder."""
    if len(patterns.components(m)) > 1:
        raise ValueError("a pattern must be connected to be listed")
    with Scratch(edges.sparkSession, "embeddings") as keep:
        return written(patterns.listed(edges, m, keep, ordered), shared_dir(edges.sparkSession, "embeddings"))


def ranked(edges: DataFrame) -> DataFrame:
    """edges + degree and degree_to of both ends, unless they are there."""
    if "degree_to" in edges.columns:
        return edges
    d = degrees(edges)
    return edges.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("degree").alias("degree_to")), "dst")


def oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the end of lower (degree, id): no vertex keeps many out-edges."""
    return ranked(edges).where("struct(degree, src) < struct(degree_to, dst)").select("src", "dst")


def cliques(edges: DataFrame, size: int) -> DataFrame:
    """v0..vk of every clique, in ascending order of (degree, id)."""
    up = oriented(edges)
    out = up.select(F.col("src").alias("v0"), F.col("dst").alias("v1"))
    for v in range(2, size):
        out = out.join(up.select(F.col("src").alias("v0"), F.col("dst").alias(f"v{v}")), "v0")
        for w in range(1, v):
            out = out.join(up.select(F.col("src").alias(f"v{w}"), F.col("dst").alias(f"v{v}")), [f"v{w}", f"v{v}"], "left_semi")
    return out


def triangles(edges: DataFrame) -> DataFrame:
    """v0 < v1 < v2 of every triangle."""
    corners = F.sort_array(F.array("v0", "v1", "v2"))
    return cliques(edges, 3).select(corners.alias("c")).select(*[F.col("c")[i].alias(f"v{i}") for i in range(3)])


def _two_paths(edges: DataFrame) -> DataFrame:
    """(top, a, b) of every path top - a - b whose top has the highest (degree, id) of the three."""
    both = ranked(edges).select("src", "dst", F.struct(F.col("degree").alias("d"), F.col("src").alias("v")).alias("low"), F.struct(F.col("degree_to").alias("d"), F.col("dst").alias("v")).alias("high"))
    down = both.where("low < high").select(F.col("high").alias("top"), F.col("src").alias("a"))
    step = both.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("high").alias("rank"))
    return down.join(step, "a").where("rank < top").select("top", "a", "b", F.col("rank").alias("rank_b"))


def _choose(k: int) -> str:
    """SQL for the number of k-subsets of a vertex's neighbours; exact in DECIMAL."""
    product, factorial = " * ".join(f"cast(greatest(degree - {i}, 0) as decimal(9,0))" for i in range(k)), 1
    for i in range(2, k + 1):
        factorial *= i
    return f"cast(({product}) / {factorial} as decimal(38,0))"


def _total(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.expr(f"cast(coalesce(sum({value}), 0) as bigint)").alias("instances"))


def _path4(edges: DataFrame, keep: Scratch) -> DataFrame:
    """Middle edges with a further neighbour at each end; where both are one vertex it is a triangle."""
    middles = _total(ranked(edges).where("src < dst"), "cast(degree - 1 as decimal(19,0)) * (degree_to - 1)")
    closed = cliques(edges, 3).agg((-3 * F.count("*")).alias("instances"))
    return middles.union(closed).agg(F.sum("instances").alias("instances"))


def _tailed(edges: DataFrame, keep: Scratch) -> DataFrame:
    corners = triangles(edges).select(F.explode(F.array("v0", "v1", "v2")).alias("src")).groupBy("src").agg(F.count("*").alias("n"))
    return _total(corners.join(degrees(edges), "src"), "cast(n as decimal(19,0)) * (degree - 2)")


def _diamond(edges: DataFrame, keep: Scratch) -> DataFrame:
    sides = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("v0", "v1"), ("v0", "v2"), ("v1", "v2"))])
    on_edge = triangles(edges).select(F.explode(sides).alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    return _total(on_edge, "cast(n as decimal(19,0)) * (n - 1) / 2")


def _square(edges: DataFrame, keep: Scratch) -> DataFrame:
    across = _two_paths(edges).groupBy("top", "b").agg(F.count("*").alias("n"))
    return _total(across, "cast(n as decimal(19,0)) * (n - 1) / 2")


def _arcs(edges: DataFrame, keep: Scratch) -> DataFrame:
    """(u, v) both ways, of vertices numbered by (degree, id); two numbers share a BIGINT (``_key``),
    so the cast stops at 2^31 vertices."""
    numbers = numbered(degrees(edges), ["degree", "src"], keep, "number").select("src", F.col("number").cast("int"))
    numbers = keep(numbers, "numbers")
    at = lambda end, out: numbers.select(F.col("src").alias(end), F.col("number").alias(out))
    return keep(edges.select("src", "dst").join(at("src", "u"), "src").join(at("dst", "v"), "dst").select("u", "v"), "arcs")


def _key(high: str, low: str) -> Column:
    return F.shiftleft(F.col(high).cast("long"), 32).bitwiseOR(F.col(low).cast("long"))


def _corners(arcs: DataFrame, keep: Scratch) -> DataFrame:
    """x < y < z of every triangle of numbered vertices."""
    up = arcs.where("u < v")
    wedges = up.select(F.col("u").alias("x"), F.col("v").alias("y")).join(up.select(F.col("u").alias("x"), F.col("v").alias("z")), "x").where("y < z")
    return keep(wedges.withColumn("_e", _key("y", "z")).join(up.select(_key("u", "v").alias("_e")), "_e", "left_semi").select("x", "y", "z"), "triangles")


def _five_cycle(edges: DataFrame, keep: Scratch) -> DataFrame:
    """Edges b < c whose ends the highest vertex reaches by two-paths top - a - b and top - e - c, less
    the pairs of paths that share a vertex (a = e, a = c or e = b): for each triangle the neighbours
    above its top and the degrees of its other corners, less three."""
    arcs = _arcs(edges, keep)
    up = arcs.where("u < v")
    paths = up.select(F.col("u").alias("a"), F.col("v").alias("top")).join(arcs.select(F.col("u").alias("a"), F.col("v").alias("b")), "a").where("b < top")
    paths = keep(paths.groupBy(_key("top", "b").alias("ends")).agg(F.count("*").alias("n")), "two-paths")
    first = paths.select(F.shiftright("ends", 32).cast("int").alias("top"), F.expr("cast(ends & 2147483647 as int)").alias("b"), F.col("n").alias("_n"))
    met = first.join(up.select(F.col("u").alias("b"), F.col("v").alias("c")), "b").where("c < top").select(_key("top", "c").alias("ends"), "_n").join(paths, "ends")
    corner = F.explode(F.array(*[F.struct(F.col(v).alias("u"), F.lit(v == "z").alias("highest")) for v in "xyz"])).alias("e")
    corners = _corners(arcs, keep).select(corner).groupBy("e.u", "e.highest").agg(F.count("*").alias("n"))
    around = arcs.groupBy("u").agg(F.count("*").alias("degree"), F.count_if(F.col("v") > F.col("u")).alias("above"))
    shared = corners.join(around, "u").select((-F.col("n") * F.when(F.col("highest"), F.col("above") - 3).otherwise(F.col("degree"))).alias("n"))
    return _total(met.select((F.col("_n") * F.col("n")).alias("n")).unionByName(shared), "n")


def _house(edges: DataFrame, keep: Scratch) -> DataFrame:
    """Triangles on the edges of squares. A two-path top - a - b is half of n - 1 squares, where n
    paths join its ends; the apex is a corner of the square where that has a chord, four times for
    each diamond."""
    arcs = _arcs(edges, keep)
    sides = F.explode(F.array(*[_key(a, b) for a, b in ("xy", "xz", "yz")])).alias("e")
    on_edge = keep(_corners(arcs, keep).select(sides).groupBy("e").agg(F.count("*").alias("t")), "sides")
    weighed = arcs.where("u < v").withColumn("e", _key("u", "v")).join(on_edge, "e", "left").select("u", "v", F.coalesce("t", F.lit(0)).alias("t"))
    weighed = keep(weighed, "weighed")
    both = weighed.unionByName(weighed.select(F.col("v").alias("u"), F.col("u").alias("v"), "t"))
    down = weighed.select(F.col("u").alias("a"), F.col("v").alias("top"), F.col("t").alias("_t"))
    paths = down.join(both.select(F.col("u").alias("a"), F.col("v").alias("b"), "t"), "a").where("b < top")
    ends = paths.groupBy(_key("top", "b").alias("ends")).agg(F.count("*").alias("n"), F.sum(F.col("_t") + F.col("t")).alias("t"))
    chords = on_edge.select((-2 * F.col("t") * (F.col("t") - 1)).alias("n"))
    return _total(ends.select(((F.col("n") - 1) * F.col("t")).alias("n")).unionByName(chords), "n")


#: Counted over numbered vertices.
_NUMBERED = {motif("5cycle"): _five_cycle, pattern("house", "01 12 23 30 04 14"): _house}
_COUNTED = {"path4": _path4, "tailed_triangle": _tailed, "diamond": _diamond, "square": _square}


def _by_parts(edges: DataFrame, m: Motif, keep: Scratch) -> DataFrame:
    """One row, instances, of any pattern: ordered embeddings of its connected parts multiplied, less
    what shares vertices."""
    terms = patterns.as_products(m.edges)
    if list(terms.values()) == [1] and len(next(iter(terms))) == 1:
        return patterns.instances(edges, m, keep)
    parts = sorted({p for t in terms for p in t})
    whole = None
    for i, p in enumerate(parts):
        one = pattern(f"part{i}", " ".join(f"{a}{b}" for a, b in p))
        known = next((motif(x) for x in MOTIFS if patterns.canonical(motif(x).edges) == p), one)
        row = count_pattern(edges, known).select(F.lit(i).alias("i"), F.col("raw_embeddings").cast("decimal(38,0)").alias("raw"))
        whole = row if whole is None else whole.unionByName(row)
    raw = {p: f"max(if(i = {i}, raw, null))" for i, p in enumerate(parts)}
    product = " + ".join(" * ".join([f"cast({n} as decimal(38,0))", *(f"cast({raw[p]} as decimal(38,0))" for p in t)]) for t, n in sorted(terms.items()))
    return whole.agg(F.expr(f"cast(({product}) / {len(m.automorphisms())} as bigint)").alias("instances"))


def count_pattern(edges: DataFrame, m: Motif) -> DataFrame:
    """One row: motif, edges (undirected), raw_embeddings, automorphisms, instances."""
    n = len(m.automorphisms())
    if m.is_star:
        found = _total(degrees(edges), _choose(m.size - 1)) if m.size > 2 else edges.agg(F.expr("count(*) div 2").alias("instances"))
    else:
        # the graph with degrees, two-paths and neighbour lists are tables while the count is taken
        with Scratch(edges.sparkSession, "motif") as keep:
            if m in _NUMBERED:
                found = _NUMBERED[m](edges, keep)
            elif m.name in _COUNTED and m == motif(m.name):
                found = _COUNTED[m.name](keep(ranked(edges), "ranked"), keep)
            elif m.is_clique:
                found = cliques(keep(ranked(edges), "ranked"), m.size).agg(F.count("*").alias("instances"))
            else:
                found = _by_parts(edges, m, keep)
            found = written(found, shared_dir(edges.sparkSession, "instances"))
    total = edges.agg(F.expr("count(*) div 2").alias("edges"))
    out = found.join(F.broadcast(total))  # one row each
    return out.select(F.lit(m.name).alias("motif"), "edges", (F.col("instances") * n).alias("raw_embeddings"), F.lit(n).cast("long").alias("automorphisms"), "instances")


def count_motif(edges: DataFrame, name: str) -> DataFrame:
    return count_pattern(edges, motif(name))


def oracle_count(m: Motif, edges_sql: str) -> str:
    """DuckDB SQL that counts ordered embeddings by one join per pattern edge."""
    pairs = sorted(tuple(sorted(e)) for e in m.edges)
    first: dict[int, str] = {}
    tables, where = [], []
    for i, (a, b) in enumerate(pairs):
        tables.append(f"e AS t{i}")
        for v, c in ((a, f"t{i}.src"), (b, f"t{i}.dst")):
            if v in first:
                where.append(f"{first[v]} = {c}")
            else:
                first[v] = c
    where += [f"{first[a]} <> {first[b]}" for a, b in combinations(range(m.size), 2)]
    n = len(m.automorphisms())
    return f"""
WITH e AS MATERIALIZED ({edges_sql}), c AS (SELECT count(*) AS raw FROM {', '.join(tables)} WHERE {' AND '.join(where)})
SELECT '{m.name}' AS motif, (SELECT count(*) // 2 FROM e) AS edges, raw AS raw_embeddings, {n}::BIGINT AS automorphisms, raw // {n} AS instances
FROM c"""
