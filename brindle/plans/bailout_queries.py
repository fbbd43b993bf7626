"""Suppliers as banks, customers as firms, orders as workers, line items as debts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import hash64
from brindle.functions.shipping import ship
from brindle.operators import allocation, bailout, rng
from brindle.operators.bailout import Policy
from brindle.plans.registry import register

P = Policy().checked()
STEP = 3

BANKS = "SELECT s_suppkey AS bank_id, (s_acctbal * 100)::BIGINT - 200000 AS liquidity, (s_nationkey % 3)::INT AS distress FROM supplier"
FIRMS = "SELECT c_custkey AS firm_id, (c_acctbal * 10)::BIGINT AS liquidity, 1000 + c_nationkey * 37 AS production_cost FROM customer"
WORKERS = "SELECT o_orderkey AS worker_id, (o_orderkey * 7 + o_custkey) % (SELECT count(*) FROM supplier) AS bank_id, o_custkey AS firm_id FROM orders"
#: A firm's loans: its orders, lent by a bank of the order's number.
FIRM_DEBTS = "SELECT o_custkey AS borrower, o_orderkey AS pos, o_orderkey % (SELECT count(*) FROM supplier) AS lender, (o_totalprice / 100)::BIGINT AS amount FROM orders"
#: A bank's loans: its lines, lent by a bank of the part's number.
BANK_DEBTS = """SELECT l_suppkey AS borrower, l_orderkey * 8 + l_linenumber AS pos, (l_suppkey + 1 + l_partkey) % (SELECT count(*) FROM supplier) AS lender, sum(l_extendedprice::BIGINT)::BIGINT AS amount
FROM lineitem GROUP BY 1, 2, 3"""
NEIGHBOURS = "SELECT DISTINCT o_custkey AS firm_id, (o_orderkey * 3) % (SELECT count(*) FROM supplier) AS bank_id FROM orders"
OFFERS = "SELECT DISTINCT l_suppkey AS borrower, (l_suppkey + 1 + l_partkey) % (SELECT count(*) FROM supplier) AS lender FROM lineitem WHERE (1 + l_partkey) % (SELECT count(*) FROM supplier) <> 0"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _with_banks(spark: SparkSession, d: str, df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(_read(spark, d, "supplier").agg(F.count("*").alias("nb"))))


def banks(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "supplier").select(F.col("s_suppkey").alias("bank_id"), (F.rint(F.col("s_acctbal") * 100).cast("long") - 200000).alias("liquidity"), (F.col("s_nationkey") % 3).alias("distress"))


def firms(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "customer").select(F.col("c_custkey").alias("firm_id"), F.rint(F.col("c_acctbal") * 10).cast("long").alias("liquidity"), (1000 + F.col("c_nationkey") * 37).cast("long").alias("production_cost"))


def workers(spark: SparkSession, d: str) -> DataFrame:
    return _with_banks(spark, d, _read(spark, d, "orders")).selectExpr("o_orderkey as worker_id", "(o_orderkey * 7 + o_custkey) % nb as bank_id", "o_custkey as firm_id")


def firm_debts(spark: SparkSession, d: str) -> DataFrame:
    return _with_banks(spark, d, _read(spark, d, "orders")).selectExpr("o_custkey as borrower", "o_orderkey as pos", "o_orderkey % nb as lender", "cast(rint(o_totalprice / 100) as bigint) as amount")


def bank_debts(spark: SparkSession, d: str) -> DataFrame:
    lines = _with_banks(spark, d, _read(spark, d, "lineitem"))
    lines = lines.selectExpr("l_suppkey as borrower", "l_orderkey * 8 + l_linenumber as pos", "(l_suppkey + 1 + l_partkey) % nb as lender", "cast(rint(l_extendedprice) as bigint) as amount")
    return lines.groupBy("borrower", "pos", "lender").agg(F.sum("amount").alias("amount"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _with_banks(spark, d, _read(spark, d, "orders")).selectExpr("o_custkey as firm_id", "(o_orderkey * 3) % nb as bank_id").distinct()


def offers(spark: SparkSession, d: str) -> DataFrame:
    lines = _with_banks(spark, d, _read(spark, d, "lineitem")).where("(1 + l_partkey) % nb <> 0")
    return lines.selectExpr("l_suppkey as borrower", "(l_suppkey + 1 + l_partkey) % nb as lender").distinct()


def _seed(entity: str, step: int, stream: int) -> str:
    return hash64.d_splitmix(hash64.d_keyed(hash64.seed_key(P.seed, 0, step, stream), [(entity, hash64.GAMMA)]))


def _draw(entity: str, step: int, stream: int, low: int, high: int) -> str:
    return f"({low} + ({_seed(entity, step, stream)} % {high - low + 1}::UBIGINT)::BIGINT)"


RATES = f"SELECT s_suppkey AS bank_id, {_draw('s_suppkey', 0, bailout.INTEREST_RATE, P.rate_low, P.rate_high)} AS rate FROM supplier"
COST = f"SELECT f.*, coalesce(n, 0) * {P.wage} AS workforce_cost FROM ({FIRMS}) f LEFT JOIN (SELECT firm_id, count(*) AS n FROM ({WORKERS}) w GROUP BY 1) c USING (firm_id)"
_D = lambda stream, low, high: _draw("firm_id", STEP, stream, low, high)
PARAMETERS = f"""SELECT *, least(sa, sb) AS shock_low, greatest(sa, sb) AS shock_high, least(pa, pb) AS profit_low, greatest(pa, pb) AS profit_high FROM (
SELECT *, {_D(bailout.FIRM_SHOCK, P.shock_low, P.shock_high)} AS sa, {_D(bailout.FIRM_SHOCK + 1, P.shock_low, P.shock_high)} AS sb,
  {_D(bailout.FIRM_PROFIT, P.profit_low, P.profit_high)} AS pa, {_D(bailout.FIRM_PROFIT + 1, P.profit_low, P.profit_high)} AS pb,
  {_D(bailout.FIRM_OPERATING_COST, P.operating_low, P.operating_high)} AS operating, {_D(bailout.FIRM_MULTIPLIER, P.multiplier_low, P.multiplier_high)} AS multiplier,
  {_D(bailout.FIRM_RARE_ROLL, 0, 100)} AS rare_roll, {_D(bailout.FIRM_RARE_IMPACT, P.rare_low, P.rare_high)} AS rare_impact,
  {_seed('firm_id', STEP, bailout.FIRM_RARE_SIGN)} % 2 = 1 AS rare_positive, {_seed('firm_id', STEP, bailout.SHOCK_SIGN)} % 2 = 1 AS shock_negative
FROM ({COST}) c) q"""
UPDATE = f"""SELECT firm_id, pc AS production_cost, liquidity + pc * profit // 100 - workforce_cost - pc * operating // 100
  + CASE WHEN rare_roll < {P.rare_probability} THEN (pc * rare_impact // 100) * (CASE WHEN rare_positive THEN 1 ELSE -1 END) ELSE 0 END AS liquidity, workforce_cost FROM (
SELECT *, production_cost * greatest(0, 100 + shock) // 100 AS pc FROM (
SELECT *, (CASE WHEN shock_negative THEN -1 ELSE 1 END) * (s * multiplier // 100) AS shock, (p * multiplier) // 100 AS profit FROM (
SELECT *, shock_low + ({_seed('firm_id', STEP, bailout.SHOCK)} % (shock_high - shock_low + 1)::UBIGINT)::BIGINT AS s,
  profit_low + ({_seed('firm_id', STEP, bailout.PROFIT)} % (profit_high - profit_low + 1)::UBIGINT)::BIGINT AS p FROM ({PARAMETERS}) a) b) c) e"""
FIRM_DUE = f"SELECT d.*, amount * {P.firm_repay} // 100 AS scheduled, greatest(f.liquidity, 0) AS cash FROM ({FIRM_DEBTS}) d JOIN ({FIRMS}) f ON f.firm_id = d.borrower"
REQUESTS = f"""SELECT firm_id, bank_id, asked FROM (SELECT n.firm_id, n.bank_id, 9000 - f.liquidity AS asked, row_number() OVER (PARTITION BY n.firm_id ORDER BY rate, n.bank_id) AS k
FROM ({FIRMS}) f JOIN ({NEIGHBOURS}) n USING (firm_id) JOIN ({RATES}) r USING (bank_id) WHERE f.liquidity < 9000) q WHERE k = 1"""
ROOM = f"SELECT q.*, CASE WHEN liquidity > 0 THEN liquidity * {P.firm_loan} // 100 ELSE 0 END AS room FROM ({REQUESTS}) q JOIN ({BANKS}) b USING (bank_id)"


def _running(source: str, group: str, asked: str, capacity: str, order: str) -> str:
    return f"greatest(0, least({asked}, {capacity} - coalesce(sum({asked}) OVER (PARTITION BY {group} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT"


BANK_DUE = f"SELECT d.*, amount * {P.bank_repay} // 100 AS scheduled, liquidity AS cash FROM ({BANK_DEBTS}) d JOIN ({BANKS}) b ON b.bank_id = d.borrower WHERE liquidity > 0"
IB_ROWS = f"""SELECT o.borrower, o.lender, -b.liquidity AS need, r.rate, l.liquidity, l.liquidity * {P.bank_loan} // 100 AS most
FROM ({OFFERS}) o JOIN ({BANKS}) b ON b.bank_id = o.borrower JOIN ({BANKS}) l ON l.bank_id = o.lender JOIN ({RATES}) r ON r.bank_id = o.lender WHERE b.liquidity < 0 AND l.liquidity > 0"""
IB_REQUESTS = f"SELECT borrower, lender, asked FROM (SELECT *, {_running('', 'borrower', 'most', 'need', 'rate, liquidity DESC, lender')} AS asked FROM ({IB_ROWS}) q) w WHERE asked > 0"
JUDGED = f"""SELECT *, distress >= {P.delay} AND distress % {P.delay} = 0 AS intervene FROM (
SELECT bank_id, liquidity, debt, deficit, CASE WHEN deficit > 0 THEN d0 + 1 ELSE 0 END AS distress FROM (
SELECT bank_id, liquidity, distress AS d0, coalesce(debt, 0) AS debt, greatest(0, coalesce(debt, 0) - liquidity) AS deficit
FROM ({BANKS}) b LEFT JOIN (SELECT borrower AS bank_id, sum(amount)::BIGINT AS debt FROM ({BANK_DEBTS}) d GROUP BY 1) o USING (bank_id)) x) y"""
BAIL = f"SELECT d.*, coalesce(o.amount_off, 0)::BIGINT AS off FROM ({BANK_DEBTS}) d LEFT JOIN (SELECT bank_id AS borrower, least(deficit * {P.coverage} // 100, debt) AS amount_off FROM ({JUDGED}) j WHERE intervene) o USING (borrower)"


@register("hash_splitmix", f"SELECT o_orderkey AS id, ({hash64.d_splitmix('o_orderkey')} >> 1)::BIGINT AS half_hash FROM orders")
def hash_splitmix(spark: SparkSession, d: str) -> DataFrame:
    df = _read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("h"))
    return hash64.splitmix(df, "h").select("id", F.expr("shiftrightunsigned(h, 1)").alias("half_hash"))


@register("rng_entity_draw", f"SELECT c_custkey AS firm_id, {_draw('c_custkey', STEP, 1000, 3, 103)} AS drawn FROM customer")
def rng_entity_draw(spark: SparkSession, d: str) -> DataFrame:
    return bailout.draw(firms(spark, d), "firm_id", "drawn", P, STEP, 1000, 3, 103).select("firm_id", "drawn")


@register("rng_worker_assignment")
def rng_worker_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Each worker's bank and firm from a generator of its own (two streams)."""
    ship(spark)
    n = {t: _read(spark, d, t).count() for t in ("supplier", "customer")}
    ids = _read(spark, d, "orders").select(F.col("o_orderkey").alias("worker_id"))
    return ids.select("worker_id", rng.assign(n["supplier"], P.seed, 2)("worker_id").alias("bank_id"), rng.assign(n["customer"], P.seed, 3)("worker_id").alias("firm_id"))


@register("rng_bank_graph")
def rng_bank_graph(spark: SparkSession, d: str) -> DataFrame:
    """Each bank's possible lenders: different banks in the order first drawn."""
    ship(spark)
    n = _read(spark, d, "supplier").count()
    drawn = banks(spark, d).select("bank_id", rng.distinct_draws(min(8, (n - 1) * 40 // 100), n, P.seed, 1)("bank_id").alias("l"))
    return drawn.select("bank_id", F.posexplode("l").alias("pos", "lender_id"))


@register("bank_rates", RATES)
def bank_rates(spark: SparkSession, d: str) -> DataFrame:
    return bailout.rates(banks(spark, d), P).select("bank_id", "rate")


@register("bank_deposits", f"SELECT bank_id, count(*) * {P.wage * (100 - P.consumption) // 100} AS deposit FROM ({WORKERS}) w GROUP BY bank_id")
def bank_deposits(spark: SparkSession, d: str) -> DataFrame:
    return bailout.deposits(workers(spark, d), P)


@register("firm_workforce_cost", f"SELECT firm_id, workforce_cost FROM ({COST}) c")
def firm_workforce_cost(spark: SparkSession, d: str) -> DataFrame:
    return bailout.workforce_cost(firms(spark, d), workers(spark, d), P).select("firm_id", "workforce_cost")


_PARAMETER_COLUMNS = ["firm_id", "shock_low", "shock_high", "profit_low", "profit_high", "operating", "multiplier", "rare_roll", "rare_impact", "rare_positive", "shock_negative"]


@register("firm_parameters", f"SELECT {', '.join(_PARAMETER_COLUMNS)} FROM ({PARAMETERS}) p")
def firm_parameters(spark: SparkSession, d: str) -> DataFrame:
    return bailout.firm_parameters(firms(spark, d), P, STEP).select(*_PARAMETER_COLUMNS)


@register("firm_update", UPDATE)
def firm_update(spark: SparkSession, d: str) -> DataFrame:
    return bailout.firm_update(bailout.workforce_cost(firms(spark, d), workers(spark, d), P), P, STEP)


@register("firm_repayments", f"SELECT borrower, pos, lender, amount, paid FROM ({allocation.oracle_largest_remainder(FIRM_DUE, 'borrower', 'scheduled', 'cash', 'lender, pos', 'paid')}) a")
def firm_repayments(spark: SparkSession, d: str) -> DataFrame:
    return bailout.firm_repayments(firms(spark, d), firm_debts(spark, d), P).select("borrower", "pos", "lender", "amount", "paid")


def _short(spark: SparkSession, d: str) -> DataFrame:
    return firms(spark, d).withColumn("liquidity", F.col("liquidity") - 9000)


@register("firm_loan_requests", REQUESTS)
def firm_loan_requests(spark: SparkSession, d: str) -> DataFrame:
    return bailout.loan_requests(_short(spark, d), neighbours(spark, d), bank_rates(spark, d))


@register("firm_loan_grants", f"SELECT firm_id, bank_id, asked, granted FROM ({allocation.oracle_largest_remainder(ROOM, 'bank_id', 'asked', 'room', 'firm_id', 'granted')}) a")
def firm_loan_grants(spark: SparkSession, d: str) -> DataFrame:
    return bailout.loan_grants(firm_loan_requests(spark, d), banks(spark, d), P).select("firm_id", "bank_id", "asked", "granted")


@register("bank_repayments", f"SELECT borrower, pos, lender, amount, {_running('', 'borrower', 'scheduled', 'cash', 'pos, lender')} AS paid FROM ({BANK_DUE}) q")
def bank_repayments(spark: SparkSession, d: str) -> DataFrame:
    return bailout.bank_repayments(banks(spark, d), bank_debts(spark, d), P).select("borrower", "pos", "lender", "amount", "paid")


@register("bank_interest", f"SELECT borrower, pos, lender, amount * (100 + rate) // 100 AS amount FROM ({BANK_DEBTS}) d JOIN ({RATES}) r ON r.bank_id = d.lender")
def bank_interest(spark: SparkSession, d: str) -> DataFrame:
    return bailout.add_interest(bank_debts(spark, d), bank_rates(spark, d)).select("borrower", "pos", "lender", "amount")


@register("interbank_requests", IB_REQUESTS)
def interbank_requests(spark: SparkSession, d: str) -> DataFrame:
    return bailout.interbank_requests(banks(spark, d), bank_rates(spark, d), offers(spark, d), P)


@register(
    "interbank_grants",
    f"SELECT borrower, lender, asked, {_running('', 'lender', 'asked', 'room', 'borrower')} AS granted FROM (SELECT q.*, liquidity * {P.bank_loan} // 100 AS room FROM ({IB_REQUESTS}) q JOIN ({BANKS}) b ON b.bank_id = q.lender) z",
)
def interbank_grants(spark: SparkSession, d: str) -> DataFrame:
    return bailout.interbank_grants(interbank_requests(spark, d), banks(spark, d), P).select("borrower", "lender", "asked", "granted")


@register("bank_distress", JUDGED)
def bank_distress(spark: SparkSession, d: str) -> DataFrame:
    return bailout.distress(banks(spark, d), bank_debts(spark, d), P).select("bank_id", "liquidity", "debt", "deficit", "distress", "intervene")


@register("bank_bail_in", f"SELECT borrower, pos, lender, amount, removed FROM ({allocation.oracle_largest_remainder(BAIL, 'borrower', 'amount', 'off', 'lender, pos', 'removed')}) a")
def bank_bail_in(spark: SparkSession, d: str) -> DataFrame:
    return bailout.bail_in(bank_distress(spark, d), bank_debts(spark, d), P).select("borrower", "pos", "lender", "amount", "removed")


@register(
    "bank_bail_out",
    f"SELECT bank_id, liquidity + money AS liquidity, money AS bail_money FROM (SELECT *, CASE WHEN intervene THEN deficit * {P.coverage} // 100 ELSE 0 END AS money FROM ({JUDGED}) j) m",
)
def bank_bail_out(spark: SparkSession, d: str) -> DataFrame:
    return bailout.bail_out(bank_distress(spark, d), P)


def _fold() -> str:
    out = f"{bailout.FNV_START}::UBIGINT"
    for c in ("bank_liquidity", "firm_liquidity", "bank_debt", "firm_debt", "bank_distress"):
        unsigned = f"(CASE WHEN {c} < 0 THEN 18446744073709551616::HUGEINT + {c} ELSE {c}::HUGEINT END)::UBIGINT"
        out = hash64.d_times(f"xor({out}, {unsigned})", bailout.FNV_PRIME)
    return out


@register(
    "bailout_totals",
    f"""SELECT bank_liquidity, firm_liquidity, bank_debt, firm_debt, bank_distress, ({_fold()} >> 1)::BIGINT AS half_checksum FROM (
SELECT (SELECT sum(liquidity) FROM ({BANKS}) b)::BIGINT AS bank_liquidity, (SELECT sum(liquidity) FROM ({FIRMS}) f)::BIGINT AS firm_liquidity,
  (SELECT sum(amount) FROM ({BANK_DEBTS}) x)::BIGINT AS bank_debt, (SELECT sum(amount) FROM ({FIRM_DEBTS}) y)::BIGINT AS firm_debt, (SELECT sum(distress) FROM ({BANKS}) b)::BIGINT AS bank_distress) t""",
)
def bailout_totals(spark: SparkSession, d: str) -> DataFrame:
    out = bailout.totals(banks(spark, d), firms(spark, d), bank_debts(spark, d), firm_debts(spark, d))
    return out.withColumn("half_checksum", F.expr("shiftrightunsigned(checksum, 1)")).drop("checksum")
