"""Patterns counted from triangles, degrees and two-paths, against every ordered embedding."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from brindle.operators import graph
from tests.test_patterns import Counted, brute

HOUSE = graph.pattern("house", "01 12 23 30 04 14")


def graphs():
    yield "complete", list(combinations(range(6), 2)), 6
    yield "wheel", [(0, i) for i in range(1, 8)] + [(i, i + 1) for i in range(1, 7)], 8
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        yield f"random {seed}", [e for e in combinations(range(10), 2) if rng.random() < 0.5], 10
    yield "none", [(0, 1)], 2


@pytest.mark.parametrize("m", [graph.motif("5cycle"), HOUSE], ids=lambda m: m.name)
def test_counts_equal_brute_force(spark, m):
    for name, pairs, n in graphs():
        both = set(pairs) | {(b, a) for a, b in pairs}
        edges = graph.normalize(spark.createDataFrame(pairs, "src long, dst long"))
        assert graph.count_pattern(edges, m).first()["instances"] == brute(n, both, m), name


def test_no_written_table_lists_paths_between_the_same_ends(spark):
    # 40 x 3 complete bipartite: two-paths of equal ends are one row, and a house has no embeddings as rows
    pairs = [(a, 100 + b) for a in range(40) for b in range(3)]
    edges = graph.normalize(spark.createDataFrame(pairs, "src long, dst long"))
    for m in (graph.motif("5cycle"), HOUSE):
        with Counted(spark, "test") as keep:
            assert graph._NUMBERED[m](edges, keep).first()["instances"] == 0
            assert max(keep.rows.values()) <= 3 * 40 * 39
