"""The evaluation report as text, one for each strategy version: signals scored under other weights are other evidence.

Only aggregates are collected: bands by horizons, features by horizons, reasons. Cells with too few measured
outcomes say so instead of showing a figure.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation as ev
from .outcomes import HORIZONS

#: Headings (fixed values).
CELLS = ["horizon", "n", "meas", "win rate [95% CI]", "median", "mean", "p10 / p90", "runup / drawdown", "profit factor"]
FEATURES = ["feature", "horizon", "measured/total", "spearman ρ vs return"]
EXCLUDED = ["excluded reason", "outcomes"]
UNINGESTED = "incomplete_tail_coverage"
#: What a report says first and last, and of windows that were never ingested (fixed values).
HEADER = """Strategy evaluation (§22) — strategyVersion={version}
Generated {at} over {total} outcomes.

Cells with fewer than {least} measured outcomes report INSUFFICIENT
rather than a figure. §22 warns against tuning on averages from skewed data,
and a win rate drawn from a handful of outcomes is noise, not evidence.

Returns are medians with a p10/p90 spread; the mean is deliberately not the
headline. `n` counts outcomes, `tok` counts distinct tokens — outcomes from
one token are correlated, so `tok` is the honest measure of independent evidence.

Profit factor assumes a notional entry at the frozen signal price and an exit
at the horizon price. That is a measurement convention, not a trade rule:
this system does not trade and makes no claim that these results are tradeable (§28)."""
WARNING = """
!! {lost} of {total} samples ({share}%) come from windows the swap tail
   never ingested. Their features are not evidence about anything, and they
   must not be used to calibrate thresholds. Measured outcomes are unaffected:
   the coverage gate already refused to measure them."""
FOOTER = """Findings only — no recommendation is implied. Any threshold change is a human
decision and mints a new strategyVersion (§22)."""
ALL_MEASURED = "None — every outcome in the sample was measurable."


def table(headings: list[str], rows: list[list[str]]) -> str:
    """Columns of equal width, the first flush left and the others flush right."""
    widths = [max(map(len, column)) for column in zip(headings, *rows)]
    shown = ["  ".join(x.rjust(w) if i else x.ljust(w) for i, (x, w) in enumerate(zip(row, widths))) for row in (headings, *rows)]
    return "\n".join([shown[0], "  ".join("─" * w for w in widths), *shown[1:]])


def fixed(x: float, digits: int) -> str:
    """So many digits, a tie away from zero; the sign of a small negative number stays."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def percent(x: float | None) -> str:
    return "—" if x is None else f"{'+' if x >= 0 else ''}{fixed(x, 1)}%"


def factor(x: float | None, state: str) -> str:
    return {"infinite": "∞ (no losses yet)", "finite": fixed(x or 0.0, 2)}.get(state, "n/a")


def _cell(name: str, c) -> list[str]:
    head = [name, c.horizon, f"{c.n} ({c.tokens} tok)", str(c.measured)]
    if not c.sufficient:
        return [*head, "INSUFFICIENT — need more outcomes", *[""] * 5]
    rate, low, high = (fixed(100 * (x or 0.0), 0) for x in (c.win_rate, c.win_low, c.win_high))
    return [*head, f"{rate}% [{low}–{high}]", percent(c.median), percent(c.mean), f"{percent(c.p10)} / {percent(c.p90)}", f"{percent(c.median_runup)} / {percent(c.median_drawdown)}", factor(c.profit_factor, c.profit_state)]


def _grouped(samples: DataFrame, by: str, names: list[str], least: int) -> list[list[str]]:
    order = list(HORIZONS)
    found = [c for c in ev.cells(samples, [by, "horizon"], least).collect() if c[by] in names]
    return [_cell(c[by], c) for c in sorted(found, key=lambda c: (names.index(c[by]), order.index(c.horizon) if c.horizon in order else len(order)))]


def render(samples: DataFrame, version: str, at: str, least: int = 30) -> str:
    """The report of one version at the time ``at``.

    samples: version, horizon, token_id, alpha, coverage, return_pct, max_runup_pct, max_drawdown_pct, failure_reason and
    features (map of names to doubles). Without samples of the version the text is empty.
    """
    own = samples.filter((F.col("version") == version) & F.col("alpha").isNotNull())
    lost, total = own.agg(F.count_if(F.col("failure_reason") == UNINGESTED), F.count("*")).first()
    if not total:
        return ""
    banded = own.withColumn("band", ev.band(F.col("alpha"))).filter("band is not null")
    bands = _grouped(banded, "band", [name for _, name in ev.BANDS], least)
    buckets = _grouped(own.withColumn("bucket", ev.coverage_bucket(F.col("coverage"))), "bucket", ["<0.5", "0.5-0.8", ">=0.8"], least)
    order = list(HORIZONS)
    traits = sorted(ev.feature_contribution(own, "features").filter("measured > 0").collect(), key=lambda r: (r.feature, order.index(r.horizon) if r.horizon in order else len(order)))
    rho = lambda r: "INSUFFICIENT" if r.measured < least else "— (no variation)" if r.rho is None else fixed(r.rho, 2)
    reasons = ev.exclusions(banded, []).orderBy(F.desc("n"), "reason").collect()
    head = [HEADER.format(version=version, at=at, total=total, least=least)]
    if lost:
        head.append(WARNING.format(lost=lost, total=total, share=fixed(100 * lost / total, 1)))
    parts = [
        ("Outcomes by score band", table(["band", *CELLS], bands)),
        ("Feature contribution (association, not causation)", table(FEATURES, [[r.feature, r.horizon, f"{r.measured}/{r.total}", rho(r)] for r in traits])),
        ("Outcomes by evidence coverage", table(["band", *CELLS], buckets) if buckets else "No outcomes to group."),
        ("Unmeasurable outcomes", table(EXCLUDED, [[r.reason, str(r.n)] for r in reasons]) if reasons else ALL_MEASURED),
    ]
    body = [f"\n── {title} ──\n{text}" for title, text in parts]
    return "\n".join([*head, *body, "", FOOTER])
