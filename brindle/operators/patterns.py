"""Any pattern, one vertex at a time, by intersecting stored neighbour lists.

Vertices are numbered by (degree, id), so a lower number means fewer neighbours. The neighbour
lists are a table: a light vertex, of LIGHT neighbours or fewer, has one list; a heavy one has a
list for each block of BLOCK numbers. Partial embeddings are rows, and each row grows by the vertex
whose matched neighbours include the one of lowest number: its list is the shortest, and the lists
of the other matched neighbours are intersected with it. So a row is never multiplied by a hub's
neighbours while a light vertex could propose, and the last vertex is counted from the intersection
without listing it. Rows that grow by different vertices part ways and meet again once the same
vertices are matched; each such table is written, so lost executors cost no restart.

Parts of a pattern that aren't connected are counted apart: ordered embeddings of both parts are
the product of their counts less those that share vertices, which are embeddings of the patterns
that merging some vertices gives, and so on. Nothing is paired up.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.scratch import Scratch
from brindle.operators.motifs import Motif
from brindle.operators.ordering import numbered

#: Neighbours that one list holds, and numbers that a block of a heavy vertex's list spans.
LIGHT = 1024
BLOCK = 16_384


@dataclass
class Adjacency:
    """names(number, vertex), arcs(u, v) both ways, light(u, list), heavy(u, block, list); vertices
    below ``heavy_from`` are light."""

    names: DataFrame
    arcs: DataFrame
    light: DataFrame
    heavy: DataFrame
    heavy_from: int
    vertices: int


def adjacency(edges: DataFrame, keep: Scratch, light: int = LIGHT, block: int = BLOCK) -> Adjacency:
    """Neighbour lists of a normalised edge table (src, dst in both directions, no repeats)."""
    degrees = edges.groupBy("src").agg(F.count("*").alias("degree"))
    ranked = numbered(degrees, ["degree", "src"], keep, "number")
    names = keep(ranked.select("number", F.col("src").alias("vertex"), "degree"), "names")
    heavy_from, vertices = names.agg(F.count_if(F.col("degree") <= light), F.count("*")).first()
    of = lambda old, new: names.select(F.col("vertex").alias(old), F.col("number").alias(new))
    arcs = keep(edges.select("src", "dst").join(of("src", "u"), "src").join(of("dst", "v"), "dst").select("u", "v"), "arcs")
    lists = arcs.where(F.col("u") < heavy_from).groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("list"))
    blocks = arcs.where(F.col("u") >= heavy_from).groupBy("u", F.expr(f"v div {block}").alias("block")).agg(F.sort_array(F.collect_list("v")).alias("list"))
    return Adjacency(names, arcs, keep(lists, "light"), keep(blocks, "heavy"), heavy_from, vertices)


def _beside(m: Motif, matched: frozenset, v: int) -> list[int]:
    return [w for w in sorted(matched) if frozenset((v, w)) in m.edges]


def _allowed(m: Motif, matched: frozenset, v: int, less: set) -> str:
    """SQL over x: what a candidate for v must satisfy beside its neighbours."""
    tests = [f"v{w} < x" for w in matched if (w, v) in less] + [f"x < v{w}" for w in matched if (v, w) in less]
    beside = _beside(m, matched, v)
    return " and ".join(tests + [f"x <> v{w}" for w in matched if w not in beside and (w, v) not in less and (v, w) not in less]) or "true"


def _grown(rows: DataFrame, g: Adjacency, m: Motif, matched: frozenset, v: int, less: set) -> DataFrame:
    """rows + _found: candidates of vertex v, of one row or, from heavy lists, of several."""
    own, near = [f"v{w}" for w in sorted(matched)], _beside(m, matched, v)
    test = _allowed(m, matched, v, less)
    ends = F.array_sort(F.array(*[F.col(f"v{w}") for w in near]))
    rows = rows.select(*own, *[ends[i].alias(f"_at{i}") for i in range(len(near))])

    def lists(side: DataFrame, i: int, name: str, *more: str) -> DataFrame:
        return side.select(F.col("u").alias(f"_at{i}"), *more, F.col("list").alias(name))

    def narrowed(df: DataFrame) -> DataFrame:
        return df.withColumn("_found", F.expr(f"filter(_found, x -> {test})"))

    def intersected(df: DataFrame, side: DataFrame, *more: str) -> DataFrame:
        for i in range(1, len(near)):
            df = df.join(lists(side, i, "_more", *more), [f"_at{i}", *more]).withColumn("_found", F.array_intersect("_found", "_more")).drop("_more")
        return df.select(*own, "_found")

    low, high = F.col("_at0") < g.heavy_from, F.col(f"_at{len(near) - 1}") < g.heavy_from
    first = narrowed(rows.where(low if len(near) == 1 else high).join(lists(g.light, 0, "_found"), "_at0"))
    out = [intersected(first, g.light)]
    if g.heavy_from == g.vertices:
        return out[0]
    out.append(intersected(narrowed(rows.where(~low).join(lists(g.heavy, 0, "_found", "block"), "_at0")), g.heavy, "block"))
    if len(near) > 1:
        # a light proposer among heavy ones: its few candidates are looked up as edges
        mixed = narrowed(rows.where(low & ~high).join(lists(g.light, 0, "_found"), "_at0")).withColumn("_x", F.explode("_found")).drop("_found")
        for i in range(1, len(near)):
            mixed = mixed.join(g.arcs.select(F.col("u").alias(f"_at{i}"), F.col("v").alias("_x")), [f"_at{i}", "_x"], "left_semi")
        out.append(mixed.select(*own, F.array("_x").alias("_found")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def _steps(m: Motif, matched: frozenset) -> list[tuple[int, Column]]:
    """Vertices that may come next, with the rank of each as a row's choice."""
    out = []
    for v in range(m.size):
        near = _beside(m, matched, v) if v not in matched else []
        if near:
            cost = F.array_min(F.array(*[F.col(f"v{w}") for w in near]))
            out.append((v, F.struct(cost.alias("cost"), F.lit(-len(near)).alias("near"), F.lit(v).alias("v"))))
    return out


def _matched_tables(m: Motif, g: Adjacency, keep: Scratch, less: set, until: int) -> dict[frozenset, DataFrame]:
    """Tables of partial embeddings of ``until`` vertices, by the vertices matched."""
    triangles = Counter(e for e in m.edges for w in range(m.size) if all(frozenset((w, x)) in m.edges for x in e))
    a, b = sorted(min(m.edges, key=lambda e: (-triangles[e], sorted(e))))
    arcs = g.arcs.select(F.col("u").alias(f"v{a}"), F.col("v").alias(f"v{b}"))
    if (a, b) in less or (b, a) in less:
        arcs = arcs.where(f"v{a} < v{b}" if (a, b) in less else f"v{b} < v{a}")
    tables = {frozenset((a, b)): arcs}
    for _ in range(2, until):
        parts: dict[frozenset, list[DataFrame]] = {}
        for matched, rows in tables.items():
            for v, grown in _chosen(rows, g, m, matched, less):
                more = matched | {v}
                own = [f"v{w}" for w in sorted(matched)]
                parts.setdefault(more, []).append(grown.select(*own, F.explode("_found").alias(f"v{v}")))
        tables = {}
        for matched, found in parts.items():
            whole = found[0]
            for x in found[1:]:
                whole = whole.unionByName(x)
            tables[matched] = keep(whole, "matched-" + "".join(map(str, sorted(matched))))
    return tables


def _chosen(rows: DataFrame, g: Adjacency, m: Motif, matched: frozenset, less: set) -> list[tuple[int, DataFrame]]:
    """(v, the rows whose shortest list proposes v, grown) for each vertex that may come next."""
    steps = _steps(m, matched)
    if len(steps) == 1:
        return [(steps[0][0], _grown(rows, g, m, matched, steps[0][0], less))]
    rows = rows.withColumn("_next", F.array_min(F.array(*[s for _, s in steps]))["v"])
    return [(v, _grown(rows.where(F.col("_next") == v), g, m, matched, v, less)) for v, _ in steps]


def instances(edges: DataFrame, m: Motif, keep: Scratch, g: Adjacency | None = None) -> DataFrame:
    """One row, instances: the number of instances of a connected pattern of three vertices or more."""
    g = g or adjacency(edges, keep)
    less = set(m.constraints())
    counts = [grown.select(F.size("_found").cast("long").alias("n")) for matched, rows in _matched_tables(m, g, keep, less, m.size - 1).items() for _, grown in _chosen(rows, g, m, matched, less)]
    whole = counts[0]
    for x in counts[1:]:
        whole = whole.unionByName(x)
    return whole.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("instances"))


def listed(edges: DataFrame, m: Motif, keep: Scratch, ordered: bool = False, g: Adjacency | None = None) -> DataFrame:
    """v0..vk of every instance of a connected pattern by original ids: the least of its labellings,
    or all of them (every ordered embedding), if ordered."""
    g = g or adjacency(edges, keep)
    less = set(m.constraints())
    (_, rows), = _matched_tables(m, g, keep, less, m.size).items()
    for v in range(m.size):
        rows = rows.join(g.names.select(F.col("number").alias(f"v{v}"), F.col("vertex").alias(f"_{v}")), f"v{v}").drop(f"v{v}")
    forms = F.array(*[F.array(*[F.col(f"_{p[v]}") for v in range(m.size)]) for p in m.automorphisms()])
    form = F.explode(forms) if ordered else F.array_min(forms)
    return rows.select(form.alias("f")).select(*[F.col("f")[v].alias(f"v{v}") for v in range(m.size)])


# --- patterns of several parts


def components(m: Motif) -> list[frozenset]:
    """The vertex sets of a pattern's connected parts."""
    out: list[frozenset] = []
    for e in m.edges:
        touching = [c for c in out if c & e]
        out = [c for c in out if not c & e] + [frozenset(e).union(*touching)]
    return sorted(out, key=sorted)


def canonical(edges: frozenset) -> tuple:
    """The same edge tuple for all numberings of a small pattern."""
    used = sorted({v for e in edges for v in e})
    forms = ({v: i for v, i in zip(used, p, strict=True)} for p in permutations(range(len(used))))
    return min(tuple(sorted(tuple(sorted(f[v] for v in e)) for e in edges)) for f in forms)


def as_products(edges: frozenset) -> dict[tuple, int]:
    """The number of ordered embeddings of a pattern as a sum of products: (connected patterns'
    canonical edges, ...) -> factor."""
    parts = components(Motif("", 0, edges))
    if len(parts) == 1:
        return {(canonical(edges),): 1}
    one = frozenset(e for e in edges if e <= parts[0])
    rest = edges - one
    out: Counter = Counter()
    for a, x in as_products(one).items():
        for b, y in as_products(rest).items():
            out[tuple(sorted(a + b))] += x * y
    left, right = sorted(parts[0]), sorted(set().union(*parts[1:]))
    for k in range(1, min(len(left), len(right)) + 1):
        for some in combinations(left, k):
            for onto in permutations(right, k):
                same = dict(zip(some, onto, strict=True))
                merged = frozenset(frozenset(same.get(v, v) for v in e) for e in edges)
                for a, x in as_products(merged).items():
                    out[a] -= x
    return {k: n for k, n in out.items() if n}
