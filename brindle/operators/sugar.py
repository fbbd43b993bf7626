"""An agent simulation on a sugar grid, one DataFrame step at a time.

cells: row, col, capacity, sugar. agents: id, row, col, wealth, metabolism, vision. A step:
cells grow back; each agent aims at the cell in reach (its own, or up to ``vision`` cells north,
south, east or west) with most sugar, then least distance, then in that order of directions; of the
agents that aim at one cell the lowest id moves there and harvests it; the highest id in each cell
takes what sugar is left there; wealth falls by metabolism and agents without wealth die.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.iterate import cut

#: (number, row step, column step); the number breaks ties. 0 is the agent's own cell.
DIRECTIONS = ((1, -1, 0), (2, 1, 0), (3, 0, 1), (4, 0, -1))
#: Cells and cells in reach for each part of a join: some 10 MB to sort.
ROWS = 100_000


def capacity(row: Column, col: Column, height: Column, width: Column, low: int = 1, high: int = 4) -> Column:
    """Two peaks at a quarter and three quarters of the grid, falling off by rings."""

    def distance(share: float) -> Column:
        r, c = row - height * F.lit(share), col - width * F.lit(share)
        return F.sqrt(r * r + c * c)

    near, radius = F.least(distance(0.25), distance(0.75)), F.least(height, width) * F.lit(0.4)
    ring = lambda less: F.lit(min(high, max(low, high - less)))
    return F.when(near <= radius * F.lit(0.25), F.lit(high)).when(near <= radius * F.lit(0.5), ring(1)).when(near <= radius * F.lit(0.75), ring(2)).otherwise(F.lit(low))


def regrow(cells: DataFrame, growth: int = 1) -> DataFrame:
    return cells.withColumn("sugar", F.least("capacity", F.col("sugar") + growth))


def parts_for(agents: DataFrame, cells: DataFrame) -> int:
    """Into how many parts the joins deal their rows: ROWS of cells and cells in reach for each. The
    planner merges parts by their compressed size, to few that each sort far more than they shuffle."""
    seen = agents.agg(F.sum(1 + len(DIRECTIONS) * F.col("vision").cast("long"))).first()[0] or 0
    return max(agents.sparkSession.sparkContext.defaultParallelism, -(-(seen + cells.count()) // ROWS))


def targets(agents: DataFrame, cells: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, row, col, sugar, here): the cell each agent aims at, its sugar, and that of the agent's own
    cell: a join on the cells in reach, and a maximum per agent. The join deals both sides: the planner
    takes the cells in reach, many for each agent, to be as small as the agents, and would send them
    whole through the driver. Agents are dealt before they look around: they often come in one file
    split, whose task would sort the cells in reach of all."""
    parts = parts or parts_for(agents, cells)
    own = F.array(F.struct(F.lit(0).alias("way"), F.lit(0).alias("far"), F.col("row"), F.col("col")))

    def ray(way: int, down: int, right: int) -> Column:
        cell = lambda k: F.struct(F.lit(way).alias("way"), k.cast("int").alias("far"), (F.col("row") + k * down).alias("row"), (F.col("col") + k * right).alias("col"))
        return F.transform(F.sequence(F.lit(1), F.col("vision")), cell)

    rays = [ray(*d) for d in DIRECTIONS]
    reach = agents.repartition(parts, "id").select("id", F.inline(F.concat(own, *rays)))
    grid = cells.select("row", "col", "sugar").repartition(parts, "row", "col").hint("merge")
    seen = reach.repartition(parts, "row", "col").join(grid, ["row", "col"])
    best = F.max(F.struct("sugar", (-F.col("far")).alias("near"), (-F.col("way")).alias("order"), "row", "col")).alias("best")
    here = F.max(F.when(F.col("way") == 0, F.col("sugar"))).alias("here")
    return seen.repartition(parts, "id").groupBy("id").agg(best, here).select("id", "best.row", "best.col", "best.sugar", "here")


def winners(aims: DataFrame) -> DataFrame:
    """(row, col, id): of those that aim at a cell, the lowest id."""
    return aims.groupBy("row", "col").agg(F.min("id").alias("id"))


def occupants(agents: DataFrame) -> DataFrame:
    """(row, col, id): the highest id in each cell."""
    return agents.groupBy("row", "col").agg(F.max("id").alias("id"))


def move(agents: DataFrame, aims: DataFrame, parts: int) -> DataFrame:
    """agents + won and here: winners move to their cells and harvest them; here is the sugar that
    the others stand on. Aims are read twice and should be cut."""
    first = winners(aims.repartition(parts, "row", "col")).select("id", F.lit(True).alias("won")).repartition(parts, "id").hint("merge")
    aims = aims.select("id", F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("sugar").alias("got"), "here").repartition(parts, "id").hint("merge")
    moved = agents.repartition(parts, "id").join(aims, "id", "left").join(first, "id", "left").withColumn("won", F.coalesce("won", F.lit(False)))
    moved = moved.withColumn("row", F.when(F.col("won"), F.col("to_row")).otherwise(F.col("row"))).withColumn("col", F.when(F.col("won"), F.col("to_col")).otherwise(F.col("col")))
    return moved.withColumn("wealth", F.col("wealth") + F.when(F.col("won"), F.coalesce("got", F.lit(0))).otherwise(0)).drop("to_row", "to_col", "got")


def held(moved: DataFrame, parts: int) -> DataFrame:
    """(row, col, id, won, got): each cell with agents, its occupant, whether one has moved there and
    harvested it, and what sugar is left for the occupant, which those who stay there know."""
    stays = F.max(F.when(~F.col("won"), F.col("here")))
    cell = moved.repartition(parts, "row", "col").groupBy("row", "col").agg(F.max("id").alias("id"), F.max("won").alias("won"), stays.alias("here"))
    return cell.select("row", "col", "id", "won", F.when(~F.col("won") & (F.col("here") > 0), F.col("here")).otherwise(0).alias("got"))


def harvest(moved: DataFrame, cells: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Each cell's occupant takes the sugar left in it: (agents, cells)."""
    taken = held(moved, parts)
    here = taken.where("got > 0").select("id", "got").repartition(parts, "id").hint("merge")
    fed = moved.drop("won", "here").join(here, "id", "left").withColumn("wealth", F.col("wealth") + F.coalesce("got", F.lit(0))).drop("got")
    left = cells.repartition(parts, "row", "col").join(taken.select("row", "col", "won").hint("merge"), ["row", "col"], "left")
    empty = F.col("won") | (F.col("won").isNotNull() & (F.col("sugar") > 0))
    return fed, left.withColumn("sugar", F.when(empty, F.lit(0)).otherwise(F.col("sugar"))).drop("won")


def live(agents: DataFrame) -> DataFrame:
    return agents.withColumn("wealth", F.col("wealth") - F.col("metabolism")).where("wealth > 0")


def step(agents: DataFrame, cells: DataFrame, first: bool = False, growth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(agents, cells) after a step; the aims, which both need, are cut from their lineage."""
    parts = parts_for(agents, cells)
    if not first:
        cells = regrow(cells, growth)
    agents, cells = harvest(move(agents, cut(targets(agents, cells, parts)), parts), cells, parts)
    return live(agents), cells


def run(agents: DataFrame, cells: DataFrame, steps: int, growth: int = 1) -> tuple[DataFrame, DataFrame]:
    """All steps; each one's tables are cut from their lineage."""
    for t in range(steps):
        agents, cells = map(cut, step(agents, cells, t == 0, growth))
    return agents, cells


def totals(agents: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: live_agents, total_wealth, total_sugar."""
    a = agents.agg(F.count("*").alias("live_agents"), F.coalesce(F.sum("wealth"), F.lit(0)).cast("long").alias("total_wealth"))
    return a.join(F.broadcast(cells.agg(F.sum("sugar").cast("long").alias("total_sugar"))))


def oracle_steps(agents_sql: str, cells_sql: str, steps: int, growth: int = 1) -> str:
    """DuckDB CTEs a0, c0 .. a<steps>, c<steps>, unrolled."""
    rays = " UNION ALL ".join(f"SELECT id, {w} AS way, k AS far, row + k * {dr} AS row, col + k * {dc} AS col FROM (SELECT *, unnest(range(1, vision + 1)) AS k FROM a{{t}})" for w, dr, dc in DIRECTIONS)
    out = [f"a0 AS ({agents_sql})", f"c0 AS ({cells_sql})"]
    for t in range(steps):
        grown = f"SELECT * FROM c{t}" if t == 0 else f"SELECT row, col, capacity, least(capacity, sugar + {growth}) AS sugar FROM c{t}"
        reach = f"SELECT id, 0 AS way, 0 AS far, row, col FROM a{t} UNION ALL {rays.format(t=t)}"
        out += [
            f"g{t} AS ({grown})",
            f"s{t} AS (SELECT id, row, col FROM (SELECT r.*, row_number() OVER (PARTITION BY id ORDER BY sugar DESC, far, way) AS n FROM ({reach}) r JOIN g{t} USING (row, col)) WHERE n = 1)",
            f"w{t} AS (SELECT s.row, s.col, min(id) AS id, any_value(sugar) AS got FROM s{t} s JOIN g{t} USING (row, col) GROUP BY s.row, s.col)",
            f"m{t} AS (SELECT a.id, coalesce(w.row, a.row) AS row, coalesce(w.col, a.col) AS col, a.wealth + coalesce(w.got, 0) AS wealth, metabolism, vision FROM a{t} a LEFT JOIN w{t} w USING (id))",
            f"e{t} AS (SELECT g.row, g.col, capacity, CASE WHEN w.id IS NULL THEN sugar ELSE 0 END AS sugar FROM g{t} g LEFT JOIN w{t} w ON w.row = g.row AND w.col = g.col)",
            f"o{t} AS (SELECT m.row, m.col, max(m.id) AS id, any_value(e.sugar) AS got FROM m{t} m JOIN e{t} e ON m.row = e.row AND m.col = e.col WHERE e.sugar > 0 GROUP BY m.row, m.col)",
            f"a{t + 1} AS (SELECT * FROM (SELECT m.id, m.row, m.col, m.wealth + coalesce(o.got, 0) - m.metabolism AS wealth, metabolism, vision FROM m{t} m LEFT JOIN o{t} o USING (id)) WHERE wealth > 0)",
            f"c{t + 1} AS (SELECT e.row, e.col, capacity, CASE WHEN o.id IS NULL THEN sugar ELSE 0 END AS sugar FROM e{t} e LEFT JOIN o{t} o ON o.row = e.row AND o.col = e.col)",
        ]
    return ",\n".join(out)
