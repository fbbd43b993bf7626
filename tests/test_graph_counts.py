"""Counts of patterns, splits of groups and file round trips against plain Python."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import allocation, graph
from brindle.sources import text


def brute(n: int, edges: set, m: graph.Motif) -> int:
    raw = sum(all((p[a], p[b]) in edges for a, b in map(tuple, m.edges)) for p in permutations(range(n), m.size))
    return raw // len(m.automorphisms())


@pytest.fixture(scope="module")
def hubs(spark):
    """A small graph with two hubs, so that (degree, id) and id order differ."""
    r = np.random.default_rng(4)
    pairs = {(int(a), int(b)) for a, b in r.integers(0, 11, (26, 2)) if a != b} | {(7, i) for i in range(11) if i != 7} | {(2, i) for i in range(9) if i != 2}
    both = pairs | {(b, a) for a, b in pairs}
    return 11, both, graph.normalize(spark.createDataFrame(sorted(pairs), "src long, dst long"))


@pytest.mark.parametrize("name", sorted(graph.MOTIFS))
def test_counts_against_brute_force(hubs, name):
    n, both, edges = hubs
    got = graph.count_motif(edges, name).first()
    assert (got["instances"], got["edges"]) == (brute(n, both, graph.motif(name)), len(both) // 2)


@pytest.mark.parametrize("edges_of", ["02 12 13", "03 13 23 12", "01 12 20 23 34"])
def test_patterns_in_any_vertex_order(hubs, edges_of):
    n, both, edges = hubs
    m = graph.pattern("own", edges_of)
    assert graph.count_pattern(edges, m).first()["instances"] == brute(n, both, m)


def test_odd_patterns(hubs):
    with pytest.raises(ValueError, match="connected"):
        graph.embeddings(hubs[2], graph.pattern("two parts", "01 23"))
    with pytest.raises(ValueError, match="two different"):
        graph.pattern("loop", "00 01")
    empty = hubs[2].limit(0)
    assert all(graph.count_motif(empty, m).first()["instances"] == 0 for m in graph.MOTIFS)


def test_neighbours_in_blocks(hubs, spark):
    _, both, edges = hubs
    got = {(r["vertex"], r["block"]): r["neighbours"] for r in graph.neighbours(edges, 4).collect()}
    want: dict = {}
    for a, b in sorted(both):
        want.setdefault((a, b // 4), []).append(b)
    assert got == want
    pairs = spark.createDataFrame([(0, 7), (7, 7), (3, 99)], "src long, dst long")
    assert {(r["src"], r["dst"]): r["linked"] for r in graph.has_edge(pairs, edges).collect()} == {(0, 7): True, (7, 7): False, (3, 99): False}


def test_triangles_are_ascending(hubs):
    n, both, edges = hubs
    want = sorted(c for c in combinations(range(n), 3) if all(p in both for p in combinations(c, 2)))
    assert sorted(map(tuple, graph.triangles(edges).collect())) == want


def shared_plainly(rows, total):
    """Largest remainder of one group's (id, weight) rows."""
    whole = sum(w for _, w in rows)
    if not whole:
        return {i: 0 for i, _ in rows}
    share = {i: min(total * w // whole, w) for i, w in rows}
    left = min(total, whole) - sum(share.values())
    rest = sorted((-Fraction(total * w % whole), i) for i, w in rows if share[i] < w)
    for _, i in rest[: max(0, left)]:
        share[i] += 1
    return share


def test_largest_remainder_of_a_hot_group(spark):
    r = np.random.default_rng(8)
    rows = [("hot" if i % 3 else f"g{i % 40}", i, int(w)) for i, w in enumerate(r.integers(0, 50, 3000))]
    totals = {"hot": 31_007} | {f"g{k}": 100 + 7 * k for k in range(40)}
    df = spark.createDataFrame([(g, i, w, totals[g]) for g, i, w in rows], "g string, id long, w long, total long")
    got = {x["id"]: x["share"] for x in allocation.largest_remainder(df, "g", "w", "total", ["id"]).collect()}
    want: dict = {}
    for g in totals:
        want |= shared_plainly([(i, w) for h, i, w in rows if h == g], totals[g])
    assert got == want


def test_capped_running_of_a_hot_group(spark):
    r = np.random.default_rng(9)
    rows = [("hot" if i % 3 else f"g{i % 7}", i // 2, i, int(q)) for i, q in enumerate(r.integers(0, 50, 3000))]
    df = spark.createDataFrame([(*x, 20_000 if x[0] == "hot" else 900) for x in rows], "g string, o long, id long, q long, cap long")
    got = {x["id"]: x["granted"] for x in allocation.capped_running(df, "g", "q", "cap", ["o", "id"]).collect()}
    left, want = Counter({g: 20_000 if g == "hot" else 900 for g, *_ in rows}), {}
    for g, _, i, q in sorted(rows, key=lambda x: (x[1], x[2])):
        want[i] = min(q, left[g])
        left[g] -= want[i]
    # a row that the capacity does not cover in full takes what is left, and those after it nothing
    assert got == want
    assert allocation.capped_running(df.limit(0), "g", "q", "cap", ["o"]).count() == 0


def test_edge_file_round_trip(hubs, spark, tmp_path):
    _, both, edges = hubs
    text.write_edges(edges, str(tmp_path / "edges"))
    lines = [x for p in sorted((tmp_path / "edges").glob("part-*")) for x in p.read_text().splitlines()]
    assert sorted(lines) == sorted(f"{a} {b}" for a, b in both if a < b)
    assert {tuple(r) for r in graph.normalize(text.read_edges(spark, str(tmp_path / "edges"))).collect()} == both


def test_results_append(spark, tmp_path):
    row = spark.createDataFrame([("a", 1), ("b", None)], "name string, n long")
    for _ in range(2):
        text.write_results(row, str(tmp_path / "r"), append=True)
    assert Counter(map(tuple, text.read_results(spark, str(tmp_path / "r"), row).collect())) == {("a", 1): 2, ("b", None): 2}


def test_names_and_status(spark):
    df = spark.sql("select * from values ('', 0.25D, 3, 3), ('in/g x.txt', 1.0D, 1, 3), (cast(null as string), 0.0D, 0, 3) as t(f, p, done, n)")
    name = text.log_name(F.lit("spark"), F.lit("path3"), F.lit(5), F.col("p"), F.lit(1), F.lit(2), F.col("f"))
    rows = df.select(name.alias("name"), text.run_status(F.col("done"), F.col("n")).alias("s")).collect()
    assert [tuple(r) for r in rows] == [("spark_path3_V5_p0.25_s1_N2", "OK"), ("spark_path3_Fg_x_N2", "PARTIAL_FAIL"), ("spark_path3_V5_p0_s1_N2", "FAIL")]
    at = spark.sql("select timestamp'2024-02-03 04:05:06.789' as t").select(text.timestamp_text(F.col("t")).alias("t"))
    assert at.first()["t"] == "20240203040506789"
