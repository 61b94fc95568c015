"""Run one stage. See ``velotide.plans.workflow``."""

from __future__ import annotations

import argparse

from velotide.plans import workflow as WF
from velotide.session import build_session
from velotide.settings import TEST_WEEKS


def main() -> None:
    parser = argparse.ArgumentParser(prog="velotide", description=WF.__doc__)
    stages = ("ingest", "stations", "hourly", "weather", "features", "backtest", "report",
              "rebalancing", "snapshot")
    parser.add_argument("stage", choices=stages)
    parser.add_argument("--root", required=True, help="folder of all tables, reachable by executors")
    parser.add_argument("--csv")
    parser.add_argument("--legacy")
    parser.add_argument("--zips")
    parser.add_argument("--source", choices=("forecast", "actual"), default="forecast")
    parser.add_argument("--json")
    parser.add_argument("--weather", choices=("forecast", "actual"), default="forecast")
    parser.add_argument("--models", nargs="*", choices=WF.MODELS, default=WF.MODELS)
    parser.add_argument("--levels", nargs="*", choices=WF.LEVELS, default=WF.LEVELS)
    parser.add_argument("--model", choices=WF.MODELS, default=WF.GLOBAL)
    parser.add_argument("--weeks", type=WF.parse_weeks, default=TEST_WEEKS, help="Mondays, comma-separated")
    args = parser.parse_args()
    project = WF.Project(build_session(), args.root, test_weeks=args.weeks)
    if args.stage == "ingest":
        WF.ingest(project, args.csv, args.legacy, args.zips).show(100)
    elif args.stage == "weather":
        WF.build_weather(project, args.source, args.json)
    elif args.stage == "backtest":
        WF.backtest(project, args.models, args.levels, args.weather)
    elif args.stage == "report":
        for name, table in WF.report(project).items():
            print(name)
            table.show(50, truncate=False)
    elif args.stage == "rebalancing":
        WF.rebalancing(project, args.model).show(100, truncate=False)
    else:
        stage = {"stations": WF.build_stations, "hourly": WF.build_hourly,
                 "features": WF.build_features, "snapshot": WF.snapshot}[args.stage]
        stage(project)


if __name__ == "__main__":
    main()
