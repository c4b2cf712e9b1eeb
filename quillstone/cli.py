"""Command line: fields of text files, evaluation of predictions.

    python -m quillstone.cli extract IN_DIR OUT_DIR
    python -m quillstone.cli bench GT_DIR PRED_DIR OUT_DIR [--worst N]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .functions.fields import extract_fields, validate_text
from .operators import evaluate
from .session import session
from .sources import files, sinks


def extract(spark, args) -> int:
    docs = files.ground_truth(spark, args.input)
    docs.select("name", extract_fields("text").alias("fields"), validate_text("text").alias("warnings")).write.mode("overwrite").json(args.output)
    return 0


def bench(spark, args) -> int:
    gt, pred = files.ground_truth(spark, args.truth), files.predictions(spark, args.predictions)
    if gt.isEmpty():
        print("no ground truth", file=sys.stderr)
        return 2
    for r in evaluate.extra(gt, pred).select("name").orderBy("name").toLocalIterator():
        print(f"no truth for {r.name}", file=sys.stderr)
    pairs = evaluate.paired(gt, pred)
    metrics = evaluate.document_metrics(pairs).persist()
    truth = files.sidecars(spark, args.truth)
    own = evaluate.values_of(pairs.join(truth.select("name").distinct(), "name", "left_anti"), "gt_text")
    stats = evaluate.field_stats(gt, truth.unionByName(own), evaluate.values_of(pairs, "pred_text")).persist()
    evaluate.summary(metrics).show(truncate=False)
    evaluate.field_totals(stats).show(truncate=False)
    evaluate.worst(metrics, args.worst).show(truncate=False)
    sinks.write_csv(metrics, stats, f"{args.output}/csv")
    sinks.document_records(metrics, stats).select(F.col("record").alias("value")).write.mode("overwrite").text(f"{args.output}/documents")
    sinks.aggregate_record(metrics, stats).select(F.col("record").alias("value")).write.mode("overwrite").text(f"{args.output}/aggregate")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillstone")
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("extract")
    one.add_argument("input")
    one.add_argument("output")
    one.set_defaults(run=extract)
    two = commands.add_parser("bench")
    for name in ("truth", "predictions", "output"):
        two.add_argument(name)
    two.add_argument("--worst", type=int, default=5)
    two.set_defaults(run=bench)
    args = parser.parse_args(argv)
    return args.run(session(), args)


if __name__ == "__main__":
    sys.exit(main())
