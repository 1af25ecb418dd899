"""Command line: ``python -m tallywood.plans.cli COMMAND [options] INPUT``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from tallywood.operators import coverage, extrapolate, histogram, rarefy
from tallywood.plans import report
from tallywood.sources import bam, text

COMMANDS = ("c_curve", "lc_extrap", "gc_extrap", "bound_pop", "pop_size")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallywood")
    of = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = of.add_parser(name)
        p.add_argument("input")
        p.add_argument("-o", "--output")
        p.add_argument("--hist-out", dest="hist_out")
        p.add_argument("-v", "--verbose", action="store_true")
        p.add_argument("-r", "--seed", type=int, default=408)
        if name == "gc_extrap":
            p.add_argument("-B", "--bed", action="store_true")
            p.add_argument("--bam", action="store_true")
            p.add_argument("-w", "--max-width", dest="max_width", type=int, default=10_000)
            p.add_argument("-b", "--bin-size", dest="bin_size", type=int, default=10)
        else:
            p.add_argument("-P", "--pe", action="store_true")
            p.add_argument("-H", "--hist", action="store_true")
            p.add_argument("-V", "--vals", action="store_true")
            p.add_argument("-B", "--bam", action="store_true")
        if name != "bound_pop":
            p.add_argument("-s", "--step", type=float, default={"gc_extrap": 1e8, "pop_size": 50}.get(name, 1e6))
        if name in ("lc_extrap", "gc_extrap", "pop_size"):
            p.add_argument("-e", "--extrap", type=float, default={"lc_extrap": 1e10, "gc_extrap": 1e12, "pop_size": 0}[name])
            p.add_argument("-x", "--terms", type=int, default=100)
            p.add_argument("-D", "--defects", action="store_true")
        if name == "bound_pop":
            p.add_argument("-p", "--max-points", dest="points", type=int, default=10)
        if name != "c_curve":
            p.add_argument("-n", "--bootstraps", type=int, default=500 if name == "bound_pop" else 100)
            p.add_argument("-c", "--cval", type=float, default=0.95)
            p.add_argument("-Q", "--quick", action="store_true")
    return top


def load(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The histogram of the input: a histogram before counts, then alignments, then intervals."""
    if a.command == "gc_extrap":
        if a.bed:
            bins = coverage.hashed_bins(text.read_bed(spark, a.input), a.bin_size, ["chrom", "start", "end", "name", "strand"])
        elif a.bam:
            rows = coverage.aligned(bam.read_bam(spark, a.input))
            return coverage.coverage_histogram(coverage.floor_bins(rows, a.bin_size, max_width=a.max_width), "tid")
        else:
            bins = coverage.base_bins(text.read_mapped_reads(spark, a.input), a.bin_size, ["chrom", "start", "end", "name", "strand"], max_width=a.max_width)
        return coverage.coverage_histogram(bins)
    if a.hist:
        return text.read_histogram(spark, a.input)
    if a.vals:
        return text.read_counts(spark, a.input)
    if a.bam:
        rows = coverage.aligned(bam.read_bam(spark, a.input))
        return histogram.histogram(rows, ["tid", "pos", "mtid", "mpos"] if a.pe else ["tid", "pos"])
    return coverage.deduplicated(text.read_bed(spark, a.input), a.pe)


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    a = parser().parse_args(argv)
    hist = extrapolate.local(load(spark, a))
    if a.verbose:
        for r in extrapolate.diagnostics(hist, getattr(a, "terms", 100), getattr(a, "points", 10)).orderBy("kind", "nr").collect():
            print(f"{r.kind}\t{r.nr}\t{r.value}", file=sys.stderr)
    if a.hist_out:
        with open(a.hist_out, "w") as f:
            f.write("\n".join(report.histogram(hist)) + "\n")
    if a.command == "c_curve":
        return report.rarefaction(rarefy.rarefaction_curve(hist, int(a.step)))
    if a.command == "bound_pop":
        return report.bound(extrapolate.quick_bound(hist, a.points) if a.quick else extrapolate.bound_pop(hist, a.bootstraps, a.points, level=a.cval, seed=a.seed))
    unit, scale = ("BASES", a.bin_size) if a.command == "gc_extrap" else ("READS", 1)
    step, most = a.step / scale, a.extrap / scale
    options = {"replicates": a.bootstraps, "max_terms": a.terms, "seed": a.seed, "defects": a.defects} if not a.quick else {}
    if a.command == "pop_size" and not a.quick:
        return report.population(extrapolate.pop_size(hist, a.extrap, int(a.step), a.cval, **options))
    if a.command == "pop_size":
        h = extrapolate.horizon(hist, int(a.step)).first()
        step, most = h.step, a.extrap or h.most
    if a.quick:
        curve = extrapolate.quick_curve(hist, step, most, a.terms, defects=a.defects)
        status = curve.select("status").first()[0]
        if status != "ok":
            raise SystemExit(f"no curve: {status}")
        return report.yield_curve(curve.selectExpr(f"x * {scale} as x", f"expected_distinct * {scale} as expected_distinct"), None, unit)
    if a.command == "gc_extrap":
        return report.yield_curve(extrapolate.gc_extrap(hist, scale, a.step, a.extrap, level=a.cval, **options), a.cval, unit)
    return report.yield_curve(extrapolate.lc_extrap(hist, step, most, a.cval, **options), a.cval, unit)


def main() -> None:
    spark = SparkSession.builder.appName("tallywood").getOrCreate()
    lines = run(spark, sys.argv[1:])
    out = parser().parse_args(sys.argv[1:]).output
    if out:
        with open(out, "w") as f:
            f.write("\n".join(lines) + "\n")
    else:
        print("\n".join(lines))


if __name__ == "__main__":
    main()
