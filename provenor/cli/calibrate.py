"""Calibration from the command line: report, fit, split over a labelled corpus."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from provenor.operators import calibration as C
from provenor.sources import files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["report", "fit", "split"])
    parser.add_argument("--corpus", required=True)
    parser.add_argument("--prevalence", type=float, default=1e-5)
    parser.add_argument("--bins", type=int, default=10)
    parser.add_argument("--method", choices=["auto", "platt", "isotonic"], default="auto")
    parser.add_argument("--test-fraction", type=float, default=0.3)
    parser.add_argument("--seed", type=int, default=7)
    parser.add_argument("--out")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("calibrate").getOrCreate()
    pairs = files.labelled_pairs(spark, args.corpus)
    if args.command == "report":
        print(C.report(pairs, args.prevalence, args.bins))
        return 0
    train, test = C.split_by_case(pairs, args.test_fraction, args.seed)
    if args.command == "split":
        if not args.out:
            parser.error("split needs --out")
        files.save_labelled_pairs(train, f"{args.out}/train")
        files.save_labelled_pairs(test, f"{args.out}/test")
        return 0
    n = train.count()
    method = args.method if args.method != "auto" else "isotonic" if n >= 1000 else "platt"
    fitted = C.fit_platt(train) if method == "platt" else C.fit_isotonic(train)
    error = lambda df: C.calibration_error(C.reliability_diagram(df, args.bins)).head()[0]
    after = test.withColumn("predicted", fitted.column(F.col("log_odds")))
    print(json.dumps({"method": method, "n_fit": n, "ece_before": error(test), "ece_after": error(after), "parameters": vars(fitted)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
