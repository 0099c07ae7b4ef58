"""Risk flags from a trade simulation and a security provider, and the decision they lead to.

Unknown is not safe: what wasn't answered raises a flag of its own. Codes, actions, weights,
thresholds and messages below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"LOW": 5, "MEDIUM": 15, "HIGH": 30, "CRITICAL": 100}
RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
ACTIONS = {"PASS": 0, "WARNING": 1, "FAIL": 2}
#: Code to (severity, action).
RULES = {
    "CANNOT_BUY": ("CRITICAL", "FAIL"),
    "CANNOT_SELL": ("CRITICAL", "FAIL"),
    "HONEYPOT": ("CRITICAL", "FAIL"),
    "BLACKLIST_CAPABILITY": ("CRITICAL", "FAIL"),
    "TRADING_RESTRICTION": ("CRITICAL", "FAIL"),
    "OWNER_CAN_MINT": ("HIGH", "WARNING"),
    "UNUSUAL_TAX": ("HIGH", "WARNING"),
    "LP_CONCERN": ("MEDIUM", "WARNING"),
    "HOLDER_CONCENTRATION": ("HIGH", "WARNING"),
    "OWNER_PRIVILEGES": ("MEDIUM", "WARNING"),
    "UNKNOWN_TRADEABILITY": ("MEDIUM", "WARNING"),
    "UNKNOWN_SECURITY_DATA": ("LOW", "WARNING"),
}
TAX_WARN, TAX_MOST, TOP10_WARN = 0.10, 0.25, 40.0
#: Fields of a provider's answer, by kind.
SWITCHES = ["is_honeypot", "cannot_buy", "cannot_sell_all", "is_blacklisted", "transfer_pausable", "trading_cooldown", "is_mintable", "can_take_back_ownership", "hidden_owner", "owner_change_balance"]
NUMBERS = ["buy_tax", "sell_tax", "transfer_tax", "owner_percent", "creator_percent", "lp_holder_count", "holder_count"]
CRITICAL = ["is_honeypot", "cannot_sell_all", "is_blacklisted", "transfer_pausable", "is_mintable"]


def tri(text: Column) -> Column:
    """'1' is true, '0' is false, all else unknown."""
    return F.when(text == "1", True).when(text == "0", False)


def number(text: Column) -> Column:
    """A finite number; blank or other text is unknown."""
    clean = F.trim(text)
    value = F.when(clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), clean.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are worked out once a row, however often later steps refer to them."""
    found = rows.withColumn("_once", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return found.select(*rows.columns, "_once.*")


def parsed(answer: Column) -> Column:
    """A provider's JSON, unread fields null."""
    return F.from_json(answer, ", ".join(f"{c} string" for c in SWITCHES + NUMBERS) + ", holders array<struct<percent: string>>")


def findings(answer: Column) -> Column:
    """A provider's JSON as ``found``."""
    return found(parsed(answer))


def found(text: Column) -> Column:
    """A ``parsed`` answer as a struct: tri-states, numbers, top10_percent (sum of the first ten holders) and unindexed.

    JSON that can't be read is an answer without fields, which is unindexed, as is one that lacks the four basic fields.
    """
    states = {c: tri(text[c]) for c in SWITCHES}
    values = {c: number(text[c]) for c in NUMBERS}
    ten = F.filter(F.transform(F.slice(text["holders"], 1, 10), lambda h: number(h["percent"])), lambda x: x.isNotNull())
    top = F.when(F.size(text["holders"]) > 0, F.aggregate(ten, F.lit(0.0), lambda a, x: a + x))
    bare = states["is_honeypot"].isNull() & states["is_mintable"].isNull() & values["buy_tax"].isNull() & values["sell_tax"].isNull()
    return F.struct(*(x.alias(c) for c, x in (states | values).items()), top.alias("top10_percent"), bare.alias("unindexed"))


def pool_fee(dex: Column, tier: Column) -> Column:
    """Share that a pool keeps of a trade: 0.3 %, or a tier in millionths."""
    return F.when((dex == "uniswap-v3") & (tier > 0), tier / 1e6).otherwise(0.003)


def token_tax(retained: Column, dex: Column, tier: Column) -> Column:
    """What a round trip lost beyond paying the pool's fee twice; never below zero. Null if what was retained is."""
    expected = F.pow(1 - pool_fee(dex, tier), F.lit(2.0))
    return F.when(retained.isNull(), None).when(expected <= 0, 0.0).otherwise(F.greatest(1 - F.try_divide(retained, expected), F.lit(0.0)))


def evaluated(simulation: Column, provider: Column) -> Column:
    """Flags of a simulation (flags), then those of a provider's ``findings``; without an answer the token counts as unindexed."""
    silent = flags([(F.lit(True), "UNKNOWN_SECURITY_DATA", F.lit("security provider has not indexed this token yet"))])
    return F.concat(simulation, F.when(provider.isNull(), silent).otherwise(provider_flags(provider)))


def flags(cases: list[tuple[Column, str, Column]]) -> Column:
    """Array of (code, severity, action, message) of the cases whose predicate holds; a null predicate doesn't."""
    rows = [F.when(p, F.struct(F.lit(c).alias("code"), F.lit(RULES[c][0]).alias("severity"), F.lit(RULES[c][1]).alias("action"), m.alias("message"))) for p, c, m in cases]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def simulation_flags(can_buy: Column, can_sell: Column, tax: Column, reason: Column) -> Column:
    """At most one flag. A failed purchase proves nothing; a purchase that can't be sold is a honeypot. A tax beyond the most raises the same code as one beyond the warning."""
    bought = F.coalesce(can_buy, F.lit(False))
    why = F.coalesce(reason, F.lit("unknown"))
    share = F.concat(F.lit("round-trip token tax "), F.format_string("%.1f", tax * 100), F.lit("%"))
    return flags([
        (~bought, "UNKNOWN_TRADEABILITY", F.concat(F.lit("buy simulation did not execute: "), why)),
        (bought & ~can_sell, "HONEYPOT", F.concat(F.lit("sell simulation reverted after a successful buy: "), why)),
        (bought & can_sell.isNull(), "UNKNOWN_TRADEABILITY", F.lit("sell was never attempted")),
        (bought & can_sell & (tax >= TAX_WARN), "UNUSUAL_TAX", F.when(tax >= TAX_MOST, F.concat(share, F.lit(" at or above the fail threshold"))).otherwise(share)),
    ])


def provider_flags(f: Column) -> Column:
    """Flags of ``findings``. An unindexed token has one flag; else critical fields without an answer raise one that names them."""
    known = ~f["unindexed"]
    missing = F.array_compact(F.array(*(F.when(f[c].isNull(), c) for c in CRITICAL)))
    either = lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    percent = F.when(f["top10_percent"] <= 1, f["top10_percent"] * 100).otherwise(f["top10_percent"])
    return flags([
        (f["unindexed"], "UNKNOWN_SECURITY_DATA", F.lit("security provider has not indexed this token yet")),
        (known & (F.size(missing) > 0), "UNKNOWN_SECURITY_DATA", F.concat(F.lit("security provider omitted: "), F.array_join(missing, ", "))),
        (known & f["is_honeypot"], "HONEYPOT", F.lit("provider reports honeypot")),
        (known & f["cannot_buy"], "CANNOT_BUY", F.lit("provider reports token cannot be bought")),
        (known & f["cannot_sell_all"], "CANNOT_SELL", F.lit("provider reports token cannot be fully sold")),
        (known & f["is_blacklisted"], "BLACKLIST_CAPABILITY", F.lit("contract can blacklist addresses")),
        (known & either(f["transfer_pausable"], f["trading_cooldown"]), "TRADING_RESTRICTION", F.when(f["transfer_pausable"], "transfers can be paused").otherwise("trading cooldown enforced")),
        (known & f["is_mintable"], "OWNER_CAN_MINT", F.lit("owner can mint additional supply")),
        (known & either(f["can_take_back_ownership"], f["hidden_owner"]), "OWNER_PRIVILEGES", F.lit("ownership can be reclaimed or is hidden")),
        (known & f["owner_change_balance"], "OWNER_PRIVILEGES", F.lit("owner can modify balances")),
        (known & (f["lp_holder_count"] == 0), "LP_CONCERN", F.lit("no LP holders reported")),
        (known & (percent >= TOP10_WARN), "HOLDER_CONCENTRATION", F.concat(F.lit("top 10 hold "), F.format_string("%.1f", percent), F.lit("% of supply"))),
    ])


def verdict(flags: Column) -> Column:
    """Struct of flags (how many codes), status (the strongest action) and score (weights, at most 100) of a row's flags: the worst of each code counts, once. No shuffle."""
    rank, power, weight = (F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v)))) for table in (RANK, ACTIONS, WEIGHTS))
    codes = F.array_distinct(F.transform(flags, lambda f: f["code"]))
    # the greatest rank decides, of equals the first flag
    worst = F.transform(codes, lambda c: F.aggregate(F.filter(flags, lambda f: f["code"] == c), F.get(F.filter(flags, lambda f: f["code"] == c), F.lit(0)), lambda a, f: F.when(rank[f["severity"]] > rank[a["severity"]], f).otherwise(a)))
    strongest = F.coalesce(F.array_max(F.transform(worst, lambda f: power[f["action"]])), F.lit(0))
    status = F.when(strongest == 2, "FAIL").when(strongest == 1, "WARNING").otherwise("PASS")
    score = F.least(F.lit(100), F.aggregate(worst, F.lit(0), lambda a, f: a + weight[f["severity"]]))
    return F.struct(F.size(codes).cast("long").alias("flags"), status.alias("status"), score.cast("long").alias("score"))


def decide(rows: DataFrame, key: str) -> DataFrame:
    """By key: the worst flag of each code once, status (the strongest action) and score (weights, at most 100).

    rows: key, code, severity, action; a null code is no flag.
    """
    rank = F.create_map(*(x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))))
    power = F.create_map(*(x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))))
    weight = F.create_map(*(x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))))
    worst = rows.withColumn("_r", rank[F.col("severity")]).groupBy(key, "code").agg(F.max_by(F.struct("severity", "action"), "_r").alias("_f"))
    strongest = F.max(power[F.col("_f.action")])
    status = F.when(strongest == 2, "FAIL").when(strongest == 1, "WARNING").otherwise("PASS")
    return worst.groupBy(key).agg(F.count("code").alias("flags"), status.alias("status"), F.least(F.lit(100), F.coalesce(F.sum(weight[F.col("_f.severity")]), F.lit(0))).cast("long").alias("score"))
