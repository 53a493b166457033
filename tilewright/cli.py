"""python -m tilewright.cli batch|single|convert|doctor: the pipeline from the command line."""

from __future__ import annotations

import argparse
import importlib.util
import json
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import text
from tilewright.operators import encoders, log, metadata
from tilewright.plans.pipeline import Job
from tilewright.session import session
from tilewright.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilewright", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, help_ in (("batch", "a table of slides"), ("single", "one slide of it")):
        c = sub.add_parser(name, help=help_)
        c.add_argument("--slides", required=True, help="parquet table (sid, w, h, mpp)")
        c.add_argument("--tissue", required=True, help="parquet table (sid, tissue_id, rings)")
        c.add_argument("--tiles", required=True, help="parquet table (sid, x, y, h, w, pixels)")
        c.add_argument("--job_dir", required=True)
        c.add_argument("--task", choices=("coords", "feat", "slide", "all"), default="all")
        c.add_argument("--mag", type=int, choices=(5, 10, 20, 40, 80), default=20)
        c.add_argument("--patch_size", type=int, default=256)
        c.add_argument("--overlap", type=int, default=0)
        c.add_argument("--min_tissue_proportion", type=float, default=0.0)
        c.add_argument("--patch_encoder", default="mean_rgb")
        if name == "single":
            c.add_argument("--sid", required=True)
    c = sub.add_parser("convert", help="what a conversion of a folder would do")
    c.add_argument("--input_dir", required=True)
    c.add_argument("--mpp_csv", required=True, help="columns wsi and mpp")
    c.add_argument("--downscale_by", type=float, default=1.0)
    c = sub.add_parser("doctor", help="whether this installation can run")
    c.add_argument("--profile", choices=("base", "llm"), default="base")
    c.add_argument("--json", action="store_true")
    return p


def report(outcomes: DataFrame) -> str:
    """Outcomes (sid, task, status, reason) as text: states in the order of a report."""
    group, encoder = text.task_parts(F.col("task"))
    counts = outcomes.groupBy(group.alias("task"), encoder.alias("encoder"), log.label(F.col("status"), F.col("reason")).alias("label")).agg(F.count("*").alias("n"))
    lines: dict[str, list[str]] = {}
    for r in log.report_order(counts).orderBy("task", "encoder", "place").collect():  # a row per task, encoder and state
        lines.setdefault(r["encoder"] or r["task"], []).append(f"{r['label']}: {r['n']}")
    return "\n".join(f"- {name}: {', '.join(parts)}" for name, parts in lines.items()) or "no recorded tasks"


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    slides = spark.read.parquet(args.slides)
    if args.command == "single":
        slides = slides.where(F.col("sid").cast("string") == args.sid)
    tiles = spark.read.parquet(args.tiles).withColumn("sid", F.col("sid").cast("string"))
    job = Job(
        spark, args.job_dir, slides, spark.read.parquet(args.tissue), lambda p: p.join(tiles, ["sid", "x", "y"]),
        args.patch_size, args.mag, args.overlap, args.min_tissue_proportion, encoders.encoder(args.patch_encoder),
    )
    manifest = files.start_run(args.job_dir, args.command, vars(args))
    try:
        stage = {"coords": job.coords, "feat": job.patch_features, "slide": job.slide_features, "all": job.slide_features}[args.task]
        rows = stage()
        if args.task in ("slide", "all"):
            rows.write.mode("overwrite").parquet(f"{args.job_dir}/slide_features")
        text_ = report(job.outcomes())
    except Exception as e:
        files.finish_run(args.job_dir, manifest, "", str(e)[:500])
        raise
    files.finish_run(args.job_dir, manifest, text_)
    print(text_)
    return 0


def convert(args: argparse.Namespace, spark: SparkSession) -> int:
    table = files.slide_list(spark, args.mpp_csv).withColumn("row", F.monotonically_increasing_id()).withColumnRenamed("wsi", "name")
    found = files.slide_files(spark, args.input_dir, ("",)).select(F.col("rel_path").alias("name"))
    plan = metadata.conversion_plan(found, table, files.ALL, 1 / args.downscale_by)
    plan.groupBy("plan").agg(F.count("*").alias("n"), F.min("output_mpp").alias("from_mpp"), F.max("output_mpp").alias("to_mpp")).orderBy("plan").show()
    return 0


# The order of outcomes of a check.
SEVERITY = ("FAIL", "WARN", "OK")


def checks(profile: str) -> list[tuple[str, str, str]]:
    """(name, outcome, what to do), the worst first, then by name."""
    out = []
    for module in ("pyspark", "pyarrow", "numpy", "pandas", *(("xxhash", "tiktoken") if profile == "llm" else ())):
        there = importlib.util.find_spec(module) is not None
        out.append((f"module {module}", "OK" if there else "FAIL", "" if there else f"install {module}"))
    java = shutil.which("java")
    out.append(("java", "OK" if java else "FAIL", "" if java else "install a Java runtime"))
    free = shutil.disk_usage("/").free
    out.append(("disk", "OK" if free > 10e9 else "WARN", "" if free > 10e9 else "free some disk space"))
    return sorted(out, key=lambda c: (SEVERITY.index(c[1]), c[0]))


def doctor(args: argparse.Namespace) -> int:
    found = checks(args.profile)
    if args.json:
        print(json.dumps([dict(zip(("name", "status", "fix"), c)) for c in found]))
    else:
        print("\n".join(f"{s:4} {n}" for n, s, _ in found))
        fixes = dict.fromkeys(f for _, _, f in found if f)
        print("\n".join(f"- {f}" for f in fixes))
    return int(any(s == "FAIL" for _, s, _ in found))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "doctor":
        return doctor(args)
    return (convert if args.command == "convert" else run)(args, spark or session())


if __name__ == "__main__":
    sys.exit(main())
