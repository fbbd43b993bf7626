"""Patterns of any shape, parts of a whole order, band joins and random graphs against plain Python."""

from __future__ import annotations

import random
from bisect import bisect_right
from itertools import permutations
from math import floor, log, log1p

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions.scratch import Scratch
from brindle.operators import bands, graph, ordering, patterns, random_graph


def brute(n: int, edges: set, m: graph.Motif) -> int:
    return sum(all((p[a], p[b]) in edges for a, b in map(tuple, m.edges)) for p in permutations(range(n), m.size)) // len(m.automorphisms())


@pytest.fixture(scope="module")
def hubs(spark):
    r = np.random.default_rng(4)
    pairs = {(int(a), int(b)) for a, b in r.integers(0, 9, (18, 2)) if a != b} | {(7, i) for i in range(9) if i != 7} | {(2, i) for i in range(7) if i != 2}
    both = pairs | {(b, a) for a, b in pairs}
    return 9, both, graph.normalize(spark.createDataFrame(sorted(pairs), "src long, dst long"))


CONNECTED = ["01 12 23 30 04 14", "01 02 12 03 04 34", "01 12 23 34 45 50", "01 02 03 12 34", "01 12 23"]
APART = ["01 23", "01 02 12 34", "01 12 34", "01 23 45"]


@pytest.mark.parametrize("light", [1, 3, 100])
@pytest.mark.parametrize("edges_of", CONNECTED)
def test_connected_patterns(hubs, spark, edges_of, light):
    """With light vertices, heavy ones, and rows where both meet."""
    n, both, edges = hubs
    m = graph.pattern("own", edges_of)
    with Scratch(spark, "test") as keep:
        g = patterns.adjacency(edges, keep, light=light, block=4)
        assert patterns.instances(edges, m, keep, g).first()["instances"] == brute(n, both, m)


@pytest.mark.parametrize("edges_of", APART)
def test_patterns_of_several_parts(hubs, edges_of):
    n, both, edges = hubs
    m = graph.pattern("apart", edges_of)
    got = graph.count_pattern(edges, m).first()
    assert got["instances"] == brute(n, both, m) and got["raw_embeddings"] == got["instances"] * got["automorphisms"]
    assert graph.count_pattern(edges.limit(0), m).first()["instances"] == 0


def test_products_of_parts():
    """Two edges that don't touch: pairs of edges, less those with one and with two vertices in common."""
    edge, path = ((0, 1),), ((0, 1), (0, 2))
    assert patterns.as_products(graph.pattern("x", "01 23").edges) == {(edge, edge): 1, (path,): -4, (edge,): -2}


@pytest.mark.parametrize("ordered", [False, True])
@pytest.mark.parametrize("edges_of", ["01 12 23 30", "01 12 23 30 04", "01 02"])
def test_listed_embeddings(hubs, edges_of, ordered):
    n, both, edges = hubs
    m = graph.pattern("own", edges_of)
    every = [p for p in permutations(range(n), m.size) if all((p[a], p[b]) in both for a, b in map(tuple, m.edges))]
    want = sorted(every) if ordered else sorted({min(tuple(p[x] for x in a) for a in m.automorphisms()) for p in every})
    assert sorted(map(tuple, graph.embeddings(edges, m, ordered).collect())) == want


class Counted(Scratch):
    """Counts the rows of each table that is kept."""

    def __call__(self, df, name):
        out = super().__call__(df, name)
        self.rows = {**getattr(self, "rows", {}), name: out.count()}
        return out


def test_no_table_outgrows_a_hub_graph(spark):
    """A hub beside 2,000 vertices in 1,000 triangles has two million two-paths; no table has more rows
    than three for each edge."""
    n = 2000
    rim = [(i, i + 1) for i in range(1, n, 2)]
    edges = graph.normalize(spark.createDataFrame([(0, i) for i in range(1, n + 1)] + rim, "src long, dst long"))
    m = graph.pattern("house", "01 12 23 30 04 14")
    with Counted(spark, "test") as keep:
        assert patterns.instances(edges, m, keep).first()["instances"] == 0
        assert max(keep.rows.values()) <= 3 * 2 * (n + len(rim))
    # a hub over a path: squares go through the hub, and so do houses
    path = [(i, i + 1) for i in range(1, n)]
    edges = graph.normalize(spark.createDataFrame([(0, i) for i in range(1, n + 1)] + path, "src long, dst long"))
    with Counted(spark, "test") as keep:
        got = patterns.instances(edges, m, keep).first()["instances"]
        assert max(keep.rows.values()) <= 3 * 2 * (n + len(path))
    # the hub 0 stands in the square or on top of it; the other vertices lie along the path
    small = [(0, i) for i in range(1, 9)] + [(i, i + 1) for i in range(1, 8)]
    both = set(small) | {(b, a) for a, b in small}
    few = graph.normalize(spark.createDataFrame(small, "src long, dst long"))
    with Scratch(spark, "test") as keep:
        assert patterns.instances(few, m, keep).first()["instances"] == brute(9, both, m)
    assert got > n


# --- global order


def test_numbers_and_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2]), i, rng.choice([None, 5, 7])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, id long, w long").repartition(7)
    with Scratch(spark, "test") as keep:
        got = ordering.numbered(df, ["k", "id"], keep, sums={"before": "w"})
        assert "Window" in got._jdf.queryExecution().toString() and "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
        found = {r["id"]: (r["position"], r["before"]) for r in got.collect()}
    before, want = 0, {}
    for i, (_, x, w) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
        want[x] = (i, before)
        before += w or 0
    assert found == want


@pytest.mark.parametrize(("n", "parts"), [(100, 7), (5, 8), (64, 64), (10, 1)])
def test_balanced_parts_and_their_inverse(spark, n, parts):
    df = spark.range(n).select((F.col("id") * 3).alias("key"))
    with Scratch(spark, "test") as keep:
        got = ordering.split(df, ["key"], parts, keep)
        by = {r["key"] // 3: r["part"] for r in got.collect()}
        known = ordering.bounds(got, "key")
        asked = spark.range(-2, 3 * n + 5).union(spark.createDataFrame([(None,)], "id long"))
        owners = {r["id"]: r["owner"] for r in ordering.owner(asked, "id", known).collect()}
    for part in range(parts):
        first, size = ordering.start_of(part, n, parts)
        assert [i for i, p in sorted(by.items()) if p == part] == list(range(first, first + size))
    firsts = sorted({min(3 * i for i in by if by[i] == p): p for p in set(by.values())}.items())
    for k, p in owners.items():
        at = bisect_right([f for f, _ in firsts], k) if k is not None else 0
        assert p == (firsts[at - 1][1] if at else None)


def test_parts_of_equal_weight(spark):
    rng = random.Random(3)
    rows = [(i, 10_000 if i == 50 else rng.choice([0, 1, 5, None])) for i in range(2000)]
    with Scratch(spark, "test") as keep:
        got = {r["id"]: r["part"] for r in ordering.split_by_weight(spark.createDataFrame(rows, "id long, w long"), ["id"], "w", 9, keep).collect()}
        assert ordering.split_by_weight(spark.createDataFrame([], "id long, w long"), ["id"], "w", 9, keep).count() == 0
    total, before = sum(w or 0 for _, w in rows), 0
    for i, w in rows:
        assert got[i] == min(8, before * 9 // total)
        before += w or 0
    with pytest.raises(ValueError, match="at least one part"):
        ordering.part_of("x", 5, 0)


# --- band joins


def band_rows(rng: random.Random, n: int, hot: int) -> list[tuple]:
    return [(i, "hot" if i < hot else rng.choice(["a", "b", None]), rng.choice([None, *range(-30, 60)]) if i >= hot else rng.randrange(12)) for i in range(n)]


@pytest.mark.parametrize(("width", "hot"), [(0, 4096), (3, 4096), (5, 20), (40, 7)])
def test_band_join(spark, width, hot):
    rng = random.Random(7)
    left, right = band_rows(rng, 400, 150), band_rows(rng, 300, 90)
    schema = "id long, k string, x long"
    found = bands.band_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "x", "x", width, hot=hot)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["left"]["id"], r["right"]["id"]) for r in found.collect())
    want = sorted((i, j) for i, k, x in left for j, c, y in right if k is not None and k == c and None not in (x, y) and abs(x - y) <= width)
    assert got == want


@pytest.mark.parametrize(("width", "hot"), [(0, 4096), (4, 10), (2.5, 10)])
def test_near_pairs_once(spark, width, hot):
    rows = band_rows(random.Random(8), 300, 100)
    kind = "double" if isinstance(width, float) else "long"
    df = spark.createDataFrame([(i, k, None if x is None else (float if kind == "double" else int)(x)) for i, k, x in rows], f"id long, k string, x {kind}").withColumn("_row", F.lit(1)).withColumn("_bin", F.lit(2))
    got = sorted((r["a"]["id"], r["b"]["id"]) for r in bands.near_pairs(df, ["k"], "x", ["id"], width, hot=hot).collect())
    want = sorted((i, j) for i, k, x in rows for j, c, y in rows if k is not None and k == c and None not in (x, y) and (x, i) < (y, j) and y - x <= width)
    assert got == want


# --- random graphs


def plain_gnp(n: int, p: float, seed: int, side: int) -> set:
    """Tile by tile and gap by gap, in whole numbers and one draw at a time."""
    mask, out = (1 << 64) - 1, set()

    def draw(key: int, i: int) -> float:
        z = (key + (i + 1) * 0x9E3779B97F4A7C15) & mask
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        return (((z ^ z >> 31) >> 11) + 1) * 2.0**-53

    for col in range(-(-n // side)):
        for row in range(col + 1):
            us, vs = range(row * side, min(n, row * side + side)), range(col * side, min(n, col * side + side))
            cells = [(u, v) for u in us for v in vs] if row != col else [(u, v) for v in vs for u in us if u < v]
            key, at, i = (seed * 0x94D049BB133111EB ^ row * 0xBF58476D1CE4E5B9 ^ col * 0x9E3779B97F4A7C15) & mask, -1, 0
            while True:
                at += 1 + (floor(log(draw(key, i)) / log1p(-p)) if p < 1 else 0)
                i += 1
                if at >= len(cells):
                    break
                out.add(cells[at])
    return out


@pytest.mark.parametrize(("n", "p", "edges"), [(60, 0.1, 20), (41, 0.5, 50), (33, 1.0, 16), (1, 0.5, 8), (200, 0.01, 4096)])
def test_random_graph_edge_by_edge(spark, n, p, edges):
    got = [tuple(r) for r in random_graph.numbers(spark, n, p, 5, edges).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_gnp(n, p, 5, random_graph.side_of(p, edges))
    other = random_graph.numbers(spark, n, p, 5, edges).repartition(3)
    assert {tuple(r) for r in other.collect()} == set(got)


def test_random_graph_on_ids(spark):
    ids = spark.createDataFrame([(f"v{i % 500:03d}",) for i in range(1000)] + [(None,)], "name string")
    with Scratch(spark, "test") as keep:
        got = [tuple(r) for r in random_graph.gnp(ids, "name", 0.05, 9, keep).collect()]
    pairs = 500 * 499 / 2
    assert len(set(got)) == len(got) and all("v000" <= a < b <= "v499" for a, b in got)
    assert abs(len(got) - 0.05 * pairs) < 5 * (0.05 * 0.95 * pairs) ** 0.5
    assert random_graph.numbers(spark, 50, 0.0, 1).count() == 0
    for n, p in ((0, 0.5), (5, -0.1), (5, 1.5)):
        with pytest.raises(ValueError):
            random_graph.numbers(spark, n, p, 1)


def test_random_graph_work_follows_edges(monkeypatch):
    """Draws and tiles for a sparse graph: a constant for each edge, far from one for each pair."""
    n, p, drawn = 200_000, 4e-5, []
    plain = random_graph.uniforms
    monkeypatch.setattr(random_graph, "uniforms", lambda key, first, k: drawn.append(k) or plain(key, first, k))
    side = random_graph.side_of(p)
    across = -(-n // side)
    rows, cols = random_graph.tile_at(np.arange(across * (across + 1) // 2))
    found = sum(len(random_graph.tile_edges(r, c, n, p, 1, side)[0]) for r, c in zip(rows.tolist(), cols.tolist(), strict=True))
    assert abs(found - p * n * (n - 1) / 2) < 5000
    assert sum(drawn) + len(rows) < 1.5 * found
