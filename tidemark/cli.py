"""``python -m tidemark.cli FOLDER``: the strategy evaluation over a folder of tables, as text."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import functions as F

from tidemark.operators import report
from tidemark.operators.outcomes import HORIZONS
from tidemark.session import session
from tidemark.sources.views import Views


def options(words: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("--min-n", type=int, default=30, help="measured outcomes that a cell needs")
    parser.add_argument("--since", type=datetime.datetime.fromisoformat, help="signals from this time on (UTC)")
    parser.add_argument("--horizon", choices=list(HORIZONS), help="this horizon alone")
    parser.add_argument("--strategy-version", help="this version alone")
    found = parser.parse_args(words)
    if found.min_n < 1:
        parser.error("--min-n must be positive")
    return found


def main(words: list[str] | None = None) -> str:
    from tidemark.plans.measure import samples

    asked = options(words)
    rows = samples(Views(session(), asked.folder))
    if asked.since:
        at = int(asked.since.replace(tzinfo=asked.since.tzinfo or datetime.timezone.utc).timestamp() * 1e6)
        rows = rows.filter(F.col("start") >= at)
    if asked.horizon:
        rows = rows.filter(F.col("horizon") == asked.horizon)
    rows = rows.withColumn("features", F.create_map(F.lit("coverage"), F.col("coverage")))
    versions = [asked.strategy_version] if asked.strategy_version else [r[0] for r in rows.select("version").distinct().orderBy("version").collect()]
    now = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return "\n\n".join(filter(None, (report.render(rows, version, now, asked.min_n) for version in versions)))


if __name__ == "__main__":
    print(main())
