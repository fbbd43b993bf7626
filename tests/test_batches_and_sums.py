"""Batches written once, triangles of arriving edges, exact sums, and allocation with nulls."""

from __future__ import annotations

import math
import random
from itertools import combinations

import pytest

from brindle.operators import allocation, exact_sums, graph
from brindle.sources import ledger
from brindle.streaming import triangles


def test_a_batch_is_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    df = spark.createDataFrame([(1, "a"), (2, None)], "n long, name string")
    assert ledger.read(spark, path, df.schema).count() == 0
    assert ledger.append_once(df, path, "run/1", 0) and not ledger.append_once(df, path, "run/1", 0)
    # killed after its rows were written and before they were named
    df.write.parquet(f"{path}/rows/run%2F1-000000000001-dead")
    assert ledger.read(spark, path, df.schema).count() == 2
    assert ledger.append_once(df, path, "run/1", 1) and ledger.append_once(df, path, "other", 1)
    assert sorted(map(str, ledger.read(spark, path, df.schema).collect())) == sorted(map(str, df.collect() * 3))
    # a second writer of a batch that was named meanwhile takes its rows away again
    late = "rows/run%2F1-000000000001-late"
    df.write.parquet(f"{path}/{late}")
    assert not ledger._name(spark, path, "run/1", 1, late) and not (tmp_path / "results" / late).exists()
    assert ledger.read(spark, path, df.schema).count() == 6


@pytest.fixture(scope="module")
def arrivals():
    rng = random.Random(6)
    return [[(rng.randrange(25), rng.randrange(25)) for _ in range(n)] for n in (30, 0, 40, 25, 30)]


def plain_triangles(pairs: list) -> tuple[int, int]:
    edges = {frozenset(p) for p in pairs if p[0] != p[1]}
    return len(edges), sum(all(frozenset(x) in edges for x in combinations(c, 2)) for c in combinations(range(25), 3))


def test_triangles_of_arriving_edges(spark, tmp_path, arrivals, monkeypatch):
    path, seen = f"file://{tmp_path}/graph", []
    for i, batch in enumerate(arrivals):
        edges = spark.createDataFrame(batch, "src long, dst long")
        if i == 2:  # killed between its edges and its counts, then run again
            plain = ledger.append_once
            monkeypatch.setattr(triangles.ledger, "append_once", lambda df, at, run, b: plain(df, at, run, b) if at.endswith("edges") else 1 / 0)
            with pytest.raises(ZeroDivisionError):
                triangles.add(edges, i, path)
            monkeypatch.setattr(triangles.ledger, "append_once", plain)
        triangles.add(edges, i, path)
        triangles.add(edges, i, path)
        seen += batch
        rows = triangles.counts(spark, path).collect()
        assert (sum(r["edges"] for r in rows), sum(r["triangles"] for r in rows)) == plain_triangles(seen)
        assert len(rows) == i + 1
    full = graph.count_motif(graph.normalize(spark.createDataFrame(seen, "src long, dst long")), "triangle").first()
    assert full["instances"] == plain_triangles(seen)[1]


def test_triangles_of_a_stream(spark, tmp_path, arrivals):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, batch in enumerate(arrivals):
        (folder / f"{i}.txt").write_text("# edges\n" + "".join(f"{a} {b}\n" for a, b in batch))
        query = triangles.follow(spark, f"file://{folder}", f"file://{tmp_path}/graph", per_batch=1)
        query.awaitTermination()
    rows = triangles.counts(spark, f"file://{tmp_path}/graph").collect()
    assert (sum(r["edges"] for r in rows), sum(r["triangles"] for r in rows)) == plain_triangles([p for b in arrivals for p in b])


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_exact_sums(spark, parts):
    rng = random.Random(4)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(2000)] + [1e308, -1e308, 5e-324, -0.0, 0.1, 2.0**-1022, 1.7e308] + [2.0**k for k in range(-1074, 1000, 13)] + [-(2.0**k) * (1 - 2.0**-53) for k in range(-900, 900, 7)]
    rows = [("all", v) for v in values] + [("few", v) for v in (0.1, 0.2, 0.3, None)] + [("none", None)] + [("big", 1e308)] * 3 + [("inf", float("inf")), ("inf", 1.0), ("nan", float("nan")), (None, 0.5), (None, 1e-30)]
    got = {r["k"]: r["total"] for r in exact_sums.exact_sum(spark.createDataFrame(rows, "k string, x double").repartition(parts), ["k"], "x").collect()}
    assert math.isnan(got.pop("nan"))
    assert got == {"all": math.fsum(values), "few": math.fsum([0.1, 0.2, 0.3]), "none": 0.0, "big": float("inf"), "inf": float("inf"), None: math.fsum([0.5, 1e-30])}


def test_exact_sum_of_all_prices(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("1 as k", "l_extendedprice * (1 - l_discount) as x")
    want = math.fsum(r["x"] for r in lines.collect())
    assert {exact_sums.exact_sum(lines.repartition(n), ["k"], "x").first()["total"] for n in (1, 3, 8)} == {want}


def test_allocation_with_nulls(spark):
    rows = [("a", 1, 5, 7), ("a", 2, None, 7), ("a", 3, 4, 7), (None, 4, 6, 10), (None, 5, 8, 10), ("b", 6, 3, None)]
    df = spark.createDataFrame(rows, "g string, id long, q long, cap long")
    granted = {r["id"]: r["granted"] for r in allocation.capped_running(df, "g", "q", "cap", ["id"]).collect()}
    assert granted == {1: 5, 2: 0, 3: 2, 4: 6, 5: 4, 6: 0}
    shares = {r["id"]: r["share"] for r in allocation.largest_remainder(df, "g", "q", "cap", ["id"]).collect()}
    assert shares == {1: 4, 2: 0, 3: 3, 4: 4, 5: 6, 6: 0}
