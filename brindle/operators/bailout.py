"""Phases of a bank-firm-worker contagion model, one DataFrame function each.

Money is BIGINT. Debts are rows (borrower, pos, lender, amount) whose pos gives their order. Random
parameters are hashes of (seed, run, step, entity, stream), so no phase depends on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import hash64
from brindle.operators.allocation import capped_running, largest_remainder

# Stream numbers.
INTEREST_RATE, SHOCK, PROFIT = 4, 5, 6
FIRM_SHOCK, FIRM_PROFIT, FIRM_OPERATING_COST, FIRM_MULTIPLIER = 1000, 1001, 1002, 1003
FIRM_RARE_ROLL, FIRM_RARE_IMPACT, FIRM_RARE_SIGN, SHOCK_SIGN = 1005, 1006, 1007, 1008


@dataclass(frozen=True)
class Policy:
    seed: int = 123456789
    wage: int = 500
    consumption: int = 50
    rate_low: int = 2
    rate_high: int = 9
    shock_low: int = 0
    shock_high: int = 30
    profit_low: int = 90
    profit_high: int = 130
    operating_low: int = 5
    operating_high: int = 20
    multiplier_low: int = 80
    multiplier_high: int = 120
    rare_probability: int = 10
    rare_low: int = 5
    rare_high: int = 20
    firm_repay: int = 25
    bank_repay: int = 20
    firm_loan: int = 20
    bank_loan: int = 30
    coverage: int = 50
    delay: int = 2

    def checked(self) -> Policy:
        """Percents are clamped to 100 where they are shares; reversed pairs are swapped."""
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        if self.delay <= 0:
            raise ValueError("delay must be positive")
        if min(values.values()) < 0:
            raise ValueError("parameters must not be negative")
        for k in ("consumption", "rare_probability", "firm_repay", "bank_repay", "firm_loan", "bank_loan", "coverage"):
            values[k] = min(100, values[k])
        for k in ("rate", "shock", "profit", "operating", "multiplier", "rare"):
            low, high = values[f"{k}_low"], values[f"{k}_high"]
            values[f"{k}_low"], values[f"{k}_high"] = min(low, high), max(low, high)
        return Policy(**values)


def percent(x: Column | str, p: Column | int) -> Column:
    """floor(x * p / 100) of a non-negative amount."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor((x * p).cast("decimal(38,0)") / 100).cast("long")


def draw(df: DataFrame, entity: str, out: str, p: Policy, step: int, stream: int, low: int, high: int, run: int = 0) -> DataFrame:
    """+ out: the entity's number in low..high for a step and stream."""
    return hash64.draw(hash64.entity_seed(df, entity, "_seed", p.seed, run, step, stream), "_seed", out, low, high).drop("_seed")


def workforce_cost(firms: DataFrame, workers: DataFrame, p: Policy) -> DataFrame:
    cost = workers.groupBy("firm_id").agg((F.count("*") * p.wage).alias("workforce_cost"))
    return firms.join(cost, "firm_id", "left").withColumn("workforce_cost", F.coalesce("workforce_cost", F.lit(0).cast("long")))


def deposits(workers: DataFrame, p: Policy) -> DataFrame:
    """(bank_id, deposit) of a step's wages, less what is consumed."""
    kept = p.wage * (100 - p.consumption) // 100
    return workers.groupBy("bank_id").agg((F.count("*") * kept).alias("deposit"))


def rates(banks: DataFrame, p: Policy) -> DataFrame:
    return draw(banks, "bank_id", "rate", p, 0, INTEREST_RATE, p.rate_low, p.rate_high)


def firm_parameters(firms: DataFrame, p: Policy, step: int) -> DataFrame:
    """Each firm's sorted shock and profit ranges, cost shares and rare event of a step. The second
    draw of a pair uses the next stream number."""
    pairs = (("a_shock", FIRM_SHOCK, p.shock_low, p.shock_high), ("b_shock", FIRM_SHOCK + 1, p.shock_low, p.shock_high), ("a_profit", FIRM_PROFIT, p.profit_low, p.profit_high), ("b_profit", FIRM_PROFIT + 1, p.profit_low, p.profit_high))
    single = (("operating", FIRM_OPERATING_COST, p.operating_low, p.operating_high), ("multiplier", FIRM_MULTIPLIER, p.multiplier_low, p.multiplier_high), ("rare_roll", FIRM_RARE_ROLL, 0, 100), ("rare_impact", FIRM_RARE_IMPACT, p.rare_low, p.rare_high))
    for out, stream, low, high in (*pairs, *single):
        firms = draw(firms, "firm_id", out, p, step, stream, low, high)
    for k in ("shock", "profit"):
        firms = firms.withColumn(f"{k}_low", F.least(f"a_{k}", f"b_{k}")).withColumn(f"{k}_high", F.greatest(f"a_{k}", f"b_{k}")).drop(f"a_{k}", f"b_{k}")
    for out, stream in (("rare_positive", FIRM_RARE_SIGN), ("shock_negative", SHOCK_SIGN)):
        firms = hash64.entity_seed(firms, "firm_id", "_seed", p.seed, 0, step, stream).withColumn(out, F.expr("(_seed & 1L) = 1")).drop("_seed")
    return firms


def _in_range(df: DataFrame, out: str, p: Policy, step: int, stream: int, low: str, high: str) -> DataFrame:
    df = hash64.entity_seed(df, "firm_id", "_seed", p.seed, 0, step, stream)
    return df.withColumn(out, F.expr(f"{low} + {hash64.modulo('_seed', f'({high} - {low} + 1)')}")).drop("_seed")


def firm_update(firms: DataFrame, p: Policy, step: int) -> DataFrame:
    """Shock to production cost, revenue less costs, rare event: new production_cost and liquidity."""
    f = firm_parameters(firms, p, step)
    f = _in_range(_in_range(f, "shock", p, step, SHOCK, "shock_low", "shock_high"), "profit", p, step, PROFIT, "profit_low", "profit_high")
    f = f.withColumn("shock", F.expr("if(shock_negative, -shock, shock) * multiplier div 100")).withColumn("profit", F.expr("profit * multiplier div 100"))
    f = f.withColumn("production_cost", percent("production_cost", F.greatest(F.lit(0), 100 + F.col("shock"))))
    gain = percent("production_cost", F.col("profit")) - F.col("workforce_cost") - percent("production_cost", F.col("operating"))
    impact = percent("production_cost", F.col("rare_impact")) * F.when(F.col("rare_positive"), 1).otherwise(-1)
    f = f.withColumn("liquidity", F.col("liquidity") + gain + F.when(F.col("rare_roll") < p.rare_probability, impact).otherwise(0))
    return f.select(*firms.columns)


def firm_repayments(firms: DataFrame, debts: DataFrame, p: Policy) -> DataFrame:
    """debts + paid: what each firm can pay of its scheduled repayments, by largest remainder."""
    due = debts.withColumn("scheduled", percent("amount", p.firm_repay)).join(firms.select(F.col("firm_id").alias("borrower"), F.greatest("liquidity", F.lit(0)).alias("cash")), "borrower")
    return largest_remainder(due, "borrower", "scheduled", "cash", ["lender", "pos"], "paid").drop("scheduled", "cash")


def loan_requests(firms: DataFrame, neighbours: DataFrame, bank_rates: DataFrame) -> DataFrame:
    """(firm_id, bank_id, asked): firms in deficit ask their cheapest bank (least rate, then id)."""
    asking = firms.where("liquidity < 0").select("firm_id", (-F.col("liquidity")).alias("asked"))
    offers = asking.join(neighbours, "firm_id").join(bank_rates.select("bank_id", "rate"), "bank_id")
    return offers.groupBy("firm_id", "asked").agg(F.min(F.struct("rate", "bank_id")).alias("b")).select("firm_id", "b.bank_id", "asked")


def loan_grants(requests: DataFrame, banks: DataFrame, p: Policy) -> DataFrame:
    """requests + granted: a bank lends a share of its liquidity, by largest remainder over requests."""
    room = banks.select("bank_id", F.when(F.col("liquidity") > 0, percent("liquidity", p.firm_loan)).otherwise(F.lit(0).cast("long")).alias("room"))
    return largest_remainder(requests.join(room, "bank_id"), "bank_id", "asked", "room", ["firm_id"], "granted").drop("room")


def bank_repayments(banks: DataFrame, debts: DataFrame, p: Policy) -> DataFrame:
    """debts + paid: banks pay a share of each debt in order until their cash is gone."""
    due = debts.withColumn("scheduled", percent("amount", p.bank_repay)).join(banks.where("liquidity > 0").select(F.col("bank_id").alias("borrower"), F.col("liquidity").alias("cash")), "borrower")
    return capped_running(due, "borrower", "scheduled", "cash", ["pos", "lender"], "paid").drop("scheduled", "cash")


def add_interest(debts: DataFrame, bank_rates: DataFrame) -> DataFrame:
    grown = debts.join(bank_rates.select(F.col("bank_id").alias("lender"), "rate"), "lender")
    return grown.withColumn("amount", percent("amount", 100 + F.col("rate"))).drop("rate")


def interbank_requests(banks: DataFrame, bank_rates: DataFrame, offers: DataFrame, p: Policy) -> DataFrame:
    """(borrower, lender, asked): a bank in deficit asks its sampled lenders, ordered by (rate,
    -liquidity, id), for at most a share of each one's liquidity, until its deficit is covered."""
    lenders = banks.join(bank_rates.select("bank_id", "rate"), "bank_id").where("liquidity > 0").select(F.col("bank_id").alias("lender"), "rate", "liquidity", percent("liquidity", p.bank_loan).alias("most"))
    need = banks.where("liquidity < 0").select(F.col("bank_id").alias("borrower"), (-F.col("liquidity")).alias("need"))
    rows = need.join(offers, "borrower").join(lenders, "lender")
    out = capped_running(rows, "borrower", "most", "need", ["rate", F.desc("liquidity"), "lender"], "asked")
    return out.where("asked > 0").select("borrower", "lender", "asked")


def interbank_grants(requests: DataFrame, banks: DataFrame, p: Policy) -> DataFrame:
    """requests + granted: lenders serve borrowers in order of id until their share is used."""
    room = banks.select(F.col("bank_id").alias("lender"), F.greatest(F.lit(0).cast("long"), percent(F.greatest("liquidity", F.lit(0)), p.bank_loan)).alias("room"))
    return capped_running(requests.join(room, "lender"), "lender", "asked", "room", ["borrower"], "granted").drop("room")


def distress(banks: DataFrame, debts: DataFrame, p: Policy) -> DataFrame:
    """banks + debt, deficit, distress (counted up while insolvent) and intervene."""
    owed = debts.groupBy(F.col("borrower").alias("bank_id")).agg(F.sum("amount").alias("debt"))
    out = banks.join(owed, "bank_id", "left").withColumn("debt", F.coalesce("debt", F.lit(0).cast("long")))
    out = out.withColumn("deficit", F.greatest(F.lit(0).cast("long"), F.col("debt") - F.col("liquidity")))
    out = out.withColumn("distress", F.when(F.col("deficit") > 0, F.col("distress") + 1).otherwise(0).cast("int"))
    return out.withColumn("intervene", (F.col("distress") >= p.delay) & (F.col("distress") % p.delay == 0))


def bail_in(judged: DataFrame, debts: DataFrame, p: Policy) -> DataFrame:
    """debts + removed: a share of the deficit of banks intervened on is written off their debts."""
    off = judged.where("intervene").select(F.col("bank_id").alias("borrower"), F.least(percent("deficit", p.coverage), "debt").alias("off"))
    out = debts.join(off, "borrower", "left").withColumn("off", F.coalesce("off", F.lit(0).cast("long")))
    return largest_remainder(out, "borrower", "amount", "off", ["lender", "pos"], "removed").drop("off")


def bail_out(judged: DataFrame, p: Policy) -> DataFrame:
    """(bank_id, liquidity, bail_money): the same share paid in as cash."""
    money = F.when(F.col("intervene"), percent("deficit", p.coverage)).otherwise(F.lit(0).cast("long"))
    return judged.select("bank_id", (F.col("liquidity") + money).alias("liquidity"), money.alias("bail_money"))


def totals(banks: DataFrame, firms: DataFrame, bank_debts: DataFrame, firm_debts: DataFrame) -> DataFrame:
    """One row of sums and their folded checksum (xor, then product by the FNV prime)."""
    one = lambda df, c, out: df.agg(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(out))
    out = one(banks, "liquidity", "bank_liquidity")
    for part in (one(firms, "liquidity", "firm_liquidity"), one(bank_debts, "amount", "bank_debt"), one(firm_debts, "amount", "firm_debt"), one(banks, "distress", "bank_distress")):
        out = out.join(F.broadcast(part))  # one row each
    out = out.withColumn("checksum", F.expr(hash64.literal(FNV_START)))
    for c in ("bank_liquidity", "firm_liquidity", "bank_debt", "firm_debt", "bank_distress"):
        out = out.withColumn("checksum", F.expr(f"checksum ^ {c}")).withColumn("checksum", F.expr(hash64.times("checksum", FNV_PRIME)))
    return out


#: Fixed values of the FNV-1a hash.
FNV_START, FNV_PRIME = 1469598103934665603, 1099511628211


