"""Run one evaluation over the events table: python -m episodia.plans.cli rules|forest|reconstruction SF_DIR [--minutes N]
[--profile sweep|final] [--arm a|b] [--gaps keep|drop]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..sources.telemetry import telemetry
from . import evaluation as ev
from . import experiment as ex
from . import params as P


def main(args: list[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("model", choices=["rules", "forest", "reconstruction"])
    parser.add_argument("sf_dir")
    parser.add_argument("--minutes", type=float, default=240.0)
    parser.add_argument("--profile", choices=["sweep", "final"], default="final")
    parser.add_argument("--arm", choices=["a", "b"], default="a")
    parser.add_argument("--gaps", choices=["keep", "drop"], default="keep")
    got = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = ex.experiment(P.SETTINGS, got.profile, got.arm, quantiles=P.QUANTILES, regions=P.SPLIT.regions)
    with ex.budget(got.minutes):
        p = ev.plan(telemetry(spark, got.sf_dir), settings, P.US_START, P.US_END)
        if got.model == "rules":
            out = ev.run_rules(p, settings.evaluation.quantiles)
        elif got.model == "forest":
            out = ev.run_forest(p, P.INTERVAL_US, settings.evaluation.quantiles, got.gaps == "drop")
        else:
            out = ev.run_reconstruction(p, P.INTERVAL_US)
        lines = ex.report(out["results"], out["pooled"], out.get("explanations")) if "results" in out else [f"{r['quantile']:g}: {r['rate']:.4f}" for r in out["pooled"].collect()]
        print("\n".join(lines))
    p.release()
    return lines


if __name__ == "__main__":
    main()
