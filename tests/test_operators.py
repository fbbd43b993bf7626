from __future__ import annotations

from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import hash64
from brindle.operators import allocation, bailout, graph, heat, matrix, rng, sugar
from brindle.sources import text
from brindle.streaming.edges import degree_stream


def mix(x: int) -> int:
    x = (x + hash64.GAMMA) & hash64.MASK
    x = ((x ^ x >> 30) * hash64.MIX_1) & hash64.MASK
    x = ((x ^ x >> 27) * hash64.MIX_2) & hash64.MASK
    return x ^ x >> 31


def test_coordinate_hash_vector(spark):
    df = spark.sql("select 3L as r, 5L as c")
    row = matrix.hashed(df, "r", "c", 1).select("h", hash64.unit("h").alias("u")).first()
    assert row["h"] & hash64.MASK == 11034465311576424204
    assert row["u"] == 0.5981795631513548


def test_splitmix_and_draw_match_integers(spark):
    ids = [0, 1, 2**31, 2**62, -1, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i, i) for i in ids], "id long, h long")
    got = {r["id"]: r for r in hash64.draw(hash64.splitmix(df, "h"), "h", "d", 5, 104).collect()}
    for i in ids:
        assert got[i]["h"] & hash64.MASK == mix(i & hash64.MASK)
        assert got[i]["d"] == 5 + mix(i & hash64.MASK) % 100


def test_complete_graph_counts(spark):
    edges = graph.normalize(spark.createDataFrame(list(combinations(range(4), 2)), "src long, dst long"))
    want = {"triangle": 4, "path3": 12, "square": 3, "4clique": 1, "diamond": 6, "tailed_triangle": 12, "star3": 4, "path4": 12, "star4": 0, "5cycle": 0, "5clique": 0}
    for name, n in want.items():
        assert graph.count_motif(edges, name).first()["instances"] == n, name
    assert {k: len(graph.motif(k).automorphisms()) for k in ("square", "5cycle", "5clique", "star4", "diamond")} == {"square": 8, "5cycle": 10, "5clique": 120, "star4": 24, "diamond": 4}
    with pytest.raises(ValueError, match="known are"):
        graph.motif("heptagon")


def test_edge_list(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# c\n1 2\n2 1 9\n3 3\n\n% x\na b\n")
    edges = graph.normalize(text.read_edges(spark, str(tmp_path / "g.txt")))
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (2, 1)]
    assert graph.count_motif(edges, "triangle").first()["instances"] == 0


def test_batch_file(spark, tmp_path):
    (tmp_path / "b.csv").write_text('motif,vertices,p,seed,input,debug\n# no\ntriangle,10,0.5,7,"a,b.txt",Yes,4\npath3,,,,g.txt,0\n')
    rows = [tuple(r) for r in text.read_batch(spark, str(tmp_path / "b.csv")).collect()]
    assert rows == [("triangle", 10, 0.5, 7, "a,b.txt", True, 4), ("path3", 0, 0.0, 1, "g.txt", False, 3)]


def test_products(spark):
    a = spark.range(3 * 5).select(F.expr("id div 5").alias("i"), F.expr("id % 5").alias("k"))
    b = spark.range(5 * 4).select(F.expr("id div 4").alias("k"), F.expr("id % 4").alias("j"))
    one = matrix.multiply(a.withColumn("v", matrix.ones()), b.withColumn("v", matrix.ones()))
    assert matrix.checksum(one).first()[0] == 60
    eye = matrix.multiply(a.withColumn("v", matrix.identity("i", "k")), b.withColumn("v", matrix.identity("k", "j")))
    assert matrix.checksum(eye).first()[0] == 3
    x = a.withColumn("v", F.col("i") * 3 + F.col("k"))
    y = b.withColumn("v", F.col("k") - F.col("j"))
    plain = {(r["i"], r["j"]): r["v"] for r in matrix.multiply(x, y).collect()}
    blocks = {(r["i"], r["j"]): r["v"] for r in matrix.multiply_blocks(x, y, 2).collect()}
    assert {k: v for k, v in plain.items() if v} == {k: v for k, v in blocks.items() if v}
    assert matrix.checksum_by_margins(x, y).first()[0] == sum(plain.values())
    assert [matrix.parts_of(10, 4, i) for i in range(4)] == [(0, 3), (3, 3), (6, 2), (8, 2)]


@pytest.mark.parametrize("parts", ["1", "3", "8"])
def test_heat_is_conserved_and_independent_of_partitions(spark, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        cells = spark.range(4 * 3 * 5).select((F.col("id") % 4).alias("x"), F.expr("id div 4 % 3").alias("y"), F.expr("id div 12").alias("z"))
        start = heat.initial(cells, 9)
        got = {(r["x"], r["y"], r["z"]): r["t"] for r in heat.run(start, 3, 0.4, 0.1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    t = {(r["x"], r["y"], r["z"]): r["t"] for r in start.collect()}
    total = sum(t.values())
    for _ in range(3):
        near = lambda c, a, d: t.get(tuple(v + d * (i == a) for i, v in enumerate(c)), t[c])  # noqa: E731, B023
        t = {c: 0.4 * t[c] + 0.1 * (near(c, 0, -1) + near(c, 0, 1) + near(c, 1, -1) + near(c, 1, 1) + near(c, 2, -1) + near(c, 2, 1)) for c in t}
    assert got == t
    assert abs(sum(got.values()) - total) < 1e-9


def test_largest_remainder(spark):
    rows = [("a", 1, 3, 10), ("a", 2, 3, 10), ("a", 3, 3, 10), ("a", 4, 3, 10), ("b", 1, 5, 100), ("b", 2, 7, 100), ("c", 1, 0, 5)]
    df = spark.createDataFrame(rows, "g string, id long, w long, total long")
    got = {(r["g"], r["id"]): r["share"] for r in allocation.largest_remainder(df, "g", "w", "total", ["id"]).collect()}
    assert got == {("a", 1): 3, ("a", 2): 3, ("a", 3): 2, ("a", 4): 2, ("b", 1): 5, ("b", 2): 7, ("c", 1): 0}


def test_capped_running(spark):
    df = spark.createDataFrame([(1, 1, 4, 10), (1, 2, 5, 10), (1, 3, 5, 10), (1, 4, 5, 10), (2, 1, 3, 0)], "g long, o long, q long, cap long")
    got = {(r["g"], r["o"]): r["granted"] for r in allocation.capped_running(df, "g", "q", "cap", ["o"]).collect()}
    assert got == {(1, 1): 4, (1, 2): 5, (1, 3): 1, (1, 4): 0, (2, 1): 0}


def test_xoshiro_against_integers(spark):
    def plain(seed: int, n: int) -> list[int]:
        s = []
        for _ in range(4):
            s.append(mix(seed))
            seed = (seed + hash64.GAMMA) & hash64.MASK
        rot = lambda v, k: ((v << k) | (v >> (64 - k))) & hash64.MASK
        out = []
        for _ in range(n):
            out.append(rot(s[1] * 5 & hash64.MASK, 7) * 9 & hash64.MASK)
            t = s[1] << 17 & hash64.MASK
            s[2] ^= s[0]
            s[3] ^= s[1]
            s[1] ^= s[2]
            s[0] ^= s[3]
            s[2] ^= t
            s[3] = rot(s[3], 45)
        return out

    seeds = np.array([0, 1, 2**63 + 5], dtype=np.uint64)
    g = rng.Xoshiro(seeds)
    got = np.stack([g.next() for _ in range(5)], axis=1).tolist()
    assert got == [plain(int(x), 5) for x in seeds]


def test_distinct_draws(spark):
    got = spark.range(6).select("id", rng.distinct_draws(3, 6, 42, 1)("id").alias("l")).collect()
    assert all(len(set(r["l"])) == 3 and r["id"] not in r["l"] and all(0 <= x < 6 for x in r["l"]) for r in got)


def simulate(agents, cells, steps):
    """A plain twin of the sugar step, agent by agent."""
    for t in range(steps):
        if t:
            cells = {k: (cap, min(cap, s + 1)) for k, (cap, s) in cells.items()}
        aims = {}
        for i, a in agents.items():
            options = [(-cells[a["at"]][1], 0, 0, a["at"])]
            for way, dr, dc in sugar.DIRECTIONS:
                for k in range(1, a["vision"] + 1):
                    at = (a["at"][0] + k * dr, a["at"][1] + k * dc)
                    if at in cells:
                        options.append((-cells[at][1], k, way, at))
            aims[i] = min(options)[3]
        for at in set(aims.values()):
            i = min(j for j, x in aims.items() if x == at)
            agents[i]["at"] = at
            agents[i]["wealth"] += cells[at][1]
            cells[at] = (cells[at][0], 0)
        for at in {a["at"] for a in agents.values()}:
            i = max(j for j, a in agents.items() if a["at"] == at)
            agents[i]["wealth"] += cells[at][1]
            cells[at] = (cells[at][0], 0)
        for a in agents.values():
            a["wealth"] -= a["metabolism"]
        agents = {i: a for i, a in agents.items() if a["wealth"] > 0}
    return agents, cells


def test_sugar_against_plain_twin(spark):
    r = np.random.default_rng(3)
    cells = {(i, j): (c := int(r.integers(1, 5)), c) for i in range(6) for j in range(7)}
    agents = {i: {"at": (int(r.integers(6)), int(r.integers(7))), "wealth": int(r.integers(2, 8)), "metabolism": int(r.integers(1, 4)), "vision": int(r.integers(1, 4))} for i in range(25)}
    a = spark.createDataFrame([(i, *x["at"], x["wealth"], x["metabolism"], x["vision"]) for i, x in agents.items()], "id long, row long, col long, wealth long, metabolism int, vision int")
    c = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "row long, col long, capacity int, sugar int")
    got_a, got_c = sugar.run(a, c, 3)
    want_a, want_c = simulate(agents, cells, 3)
    assert {x["id"]: ((x["row"], x["col"]), x["wealth"]) for x in got_a.collect()} == {i: (x["at"], x["wealth"]) for i, x in want_a.items()}
    assert {(x["row"], x["col"]): x["sugar"] for x in got_c.collect()} == {k: v[1] for k, v in want_c.items()}


def test_policy():
    p = bailout.Policy(consumption=150, rate_low=9, rate_high=3).checked()
    assert (p.consumption, p.rate_low, p.rate_high) == (100, 3, 9)
    with pytest.raises(ValueError, match="delay"):
        bailout.Policy(delay=0).checked()


def test_match_status(spark):
    df = spark.sql("select * from values (1.0D, 1.0D), (1.0D, 2.0D), (null, 1.0D), (1.0D, null) as t(a, b)")
    assert [r[0] for r in df.select(text.match_status(F.col("a"), F.col("b"))).collect()] == ["MATCH", "NO_MATCH", "NO_CHECKSUM", "NO_BASELINE"]


def test_degree_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1 2\n2 3\n")
    (tmp_path / "in/b.txt").write_text("2 1\n3 4\n# 9 9\n")
    q = degree_stream(spark, str(tmp_path / "in"), 1).writeStream.format("memory").queryName("degrees").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r["vertex"]: r["degree"] for r in spark.table("degrees").collect()} == {1: 1, 2: 2, 3: 2, 4: 1}


def test_agents_and_cells_meet_without_a_broadcast(spark, tmp_path):
    # the planner's guess for the agents' reach is the agents' own size, so it was sent through the driver
    spark.range(200).selectExpr("id", "id div 10 as row", "id % 10 as col", "5L as wealth", "1 as metabolism", "6 as vision").write.parquet(f"{tmp_path}/agents")
    spark.range(400).selectExpr("id div 20 as row", "id % 20 as col", "4 as capacity", "4 as sugar").write.parquet(f"{tmp_path}/cells")
    agents, cells = spark.read.parquet(f"{tmp_path}/agents"), spark.read.parquet(f"{tmp_path}/cells")
    for df in (sugar.targets(agents, cells), *sugar.step(agents, cells, first=True)):
        df.collect()
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_agents_and_cells_are_dealt_into_parts_by_their_number(spark, monkeypatch):
    # the planner merged the parts to one for each core, and their sorts ran out of heap
    agents = spark.range(200).selectExpr("id", "id div 10 as row", "id % 10 as col", "5L as wealth", "1 as metabolism", "6 as vision")
    cells = spark.range(400).selectExpr("id div 20 as row", "id % 20 as col", "4 as capacity", "4 as sugar")
    want = [sorted(df.collect()) for df in (sugar.targets(agents, cells), *sugar.step(agents, cells))]
    monkeypatch.setattr(sugar, "ROWS", 200)
    assert sugar.parts_for(agents, cells) == 27
    got = (sugar.targets(agents, cells), *sugar.step(agents, cells))
    assert [df.rdd.getNumPartitions() for df in got] == [27, 27, 27]
    assert [sorted(df.collect()) for df in got] == want


def test_agents_are_dealt_before_they_look_around(spark, tmp_path):
    # agents come in one file split, and one task sorted the cells in reach of all of them
    spark.range(200).selectExpr("id", "id div 10 as row", "id % 10 as col", "5L as wealth", "1 as metabolism", "6 as vision").coalesce(1).write.parquet(f"{tmp_path}/agents")
    spark.range(400).selectExpr("id div 20 as row", "id % 20 as col", "4 as capacity", "4 as sugar").write.parquet(f"{tmp_path}/cells")
    agents, cells = spark.read.parquet(f"{tmp_path}/agents"), spark.read.parquet(f"{tmp_path}/cells")
    plan = sugar.targets(agents, cells)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id" in plan[plan.index("Generate inline") :].partition("/agents")[0]
    # what agents do after they have looked needs no cells
    plan = sugar.step(agents, cells, first=True)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "capacity" not in plan and f"{tmp_path}/cells" not in plan


def test_agents_off_the_grid_and_in_one_cell_against_sql(spark):
    agents = [(1, 0, 0, 9, 1, 2), (2, 0, 0, 9, 1, 1), (3, 0, 0, 9, 2, 1), (4, 9, 9, 9, 1, 3), (5, 0, 3, 9, 1, 2), (6, 1, 1, 9, 1, 1), (7, -1, 1, 9, 1, 1)]
    cells = [(0, 0, 4, 4), (0, 1, 3, 0), (0, 3, 2, 2), (1, 0, 1, 0), (1, 1, 2, 0), (2, 1, 1, 1)]
    a = spark.createDataFrame(agents, "id long, row long, col long, wealth long, metabolism int, vision int")
    c = spark.createDataFrame(cells, "row long, col long, capacity int, sugar int")
    rows = lambda x, names: f"SELECT * FROM (VALUES {', '.join(map(str, x))}) t({names})"
    ctes = sugar.oracle_steps(rows(agents, '"id", "row", "col", wealth, metabolism, vision'), rows(cells, '"row", "col", capacity, sugar'), 2)
    got_a, got_c = sugar.run(a, c, 2)
    want = lambda q: sorted(duckdb.sql(f"WITH {ctes} {q}").fetchall())
    assert sorted(map(tuple, got_a.select("id", "row", "col", "wealth").collect())) == want("SELECT id, row, col, wealth FROM a2")
    assert sorted(map(tuple, got_c.select("row", "col", "sugar").collect())) == want("SELECT row, col, sugar FROM c2")
