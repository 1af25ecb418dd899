import random

import pytest

from tallywood.operators import coverage, ordering
from tallywood.sources import text

ROW = "block int, at int, chrom string, start long, end long, rule string"


def plain(rows, reach):
    """One row after another, as a reader of the file would."""
    out, before, seen, far, left = [], None, set(), {}, {}
    first = rows[0][2] if rows else None
    for b, at, c, s, e in rows:
        if before is not None:
            pc, ps, pe = before
            if c is not None and pc is not None:
                if c == pc and s is not None and ps is not None and s < ps:
                    out.append((at, "start"))
                    if e < pe:
                        out.append((at, "pair"))
                if c < pc or (c == pc and s is not None and ps is not None and s < ps):
                    out.append((at, "position"))
        if before is None or before[0] != c:
            left[c] = left.get(c, 0) + 1
            if left[c] > (2 if c == first else 1):
                out.append((at, "returns"))
        if s is not None:
            if c in far and s + reach < far[c]:
                out.append((at, "reach"))
            far[c] = max(far.get(c, s), s)
        before = (c, s, e)
    return sorted(out)


@pytest.mark.parametrize("blocks", [1, 7, 60])
def test_violations_against_reading_row_by_row(spark, blocks):
    draw = random.Random(blocks)
    rows, chroms = [], ["a", "b", None, "c"]
    for at in range(300):
        chrom = chroms[at // 40 % 4] if draw.random() < 0.95 else draw.choice(chroms)
        start = None if draw.random() < 0.03 else at + draw.randrange(-6, 6)
        rows.append((at * blocks // 300, at, chrom, start, at + draw.randrange(20)))
    df = spark.createDataFrame([(*r, "x") for r in rows], ROW).drop("rule").repartition(5)
    got = ordering.violations(df, ["block"], "at", rules=ordering.RULES, reach=7, first_may_return=True)
    assert sorted((r.at, r.rule) for r in got.collect()) == plain(rows, 7)
    one = ordering.violations(df, ["block"], "at", rules=("start",))
    assert sorted(r.at for r in one.collect()) == sorted(a for a, rule in plain(rows, 7) if rule == "start")
    assert ordering.violations(df.where("false"), ["block"], "at", rules=ordering.RULES).collect() == []
    with pytest.raises(ValueError, match="unknown rules"):
        ordering.violations(df, ["block"], "at", rules=("other",))


def test_files_keep_their_order_over_many_tasks(spark, tmp_path):
    lines = [f"c{k // 400}\t{k * 3}\t{k * 3 + 5}\tr{k}\t0\t+" for k in range(2000)]
    bad = dict(enumerate(lines))
    bad[700], bad[1500] = bad[1500], bad[700]
    for name, rows in (("good.bed", lines), ("bad.bed", bad.values())):
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        good, wrong = (text.read_bed(spark, str(tmp_path / n), keep_place=True) for n in ("good.bed", "bad.bed"))
        assert good.select("_begin").distinct().count() > 5
        rules = ("start", "pair", "position", "returns")
        assert ordering.violations(good, ordering.FILE_BLOCK, ordering.FILE_ROW, rules=rules).collect() == []
        assert ordering.checked(good, ordering.FILE_BLOCK, ordering.FILE_ROW, rules=rules) is good
        found = {(r.name, r.rule) for r in ordering.violations(wrong, ordering.FILE_BLOCK, ordering.FILE_ROW, rules=rules).collect()}
        assert found == {("r701", "returns"), ("r1200", "returns"), ("r700", "returns"), ("r1501", "returns"), ("r700", "position"), ("r701", "position")}
        with pytest.raises(ValueError, match="out of order"):
            ordering.checked(wrong, ordering.FILE_BLOCK, ordering.FILE_ROW, rules=rules)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def runs(bins, origin):
    """Counts of sorted bins, run by run, from a run of one at ``origin``; the last run is never closed."""
    hist, before, count = {}, origin, 1
    for b in sorted(bins):
        if b != before:
            hist[count] = hist.get(count, 0) + 1
            count = 1
        else:
            count += 1
        before = b
    return hist


def test_reference_histogram_of_coverage(spark):
    draw = random.Random(2)
    for case in range(12):
        bins = [(draw.choice("ab"), draw.randrange(12)) for _ in range(draw.randrange(1, 60))]
        if case % 3 == 0:
            bins.append(("a", 0))
        df = spark.createDataFrame([(c, b, case) for c, b in bins], "chrom string, bin long, sample int")
        for origin in (None, ("a", 0)):
            got = {r.multiplicity: r.n_keys for r in coverage.coverage_histogram(df, by=["sample"], compat="reference", origin=origin).collect()}
            want = runs(bins, origin)
            if origin and ("a", 0) in bins:  # the run at the origin begins with one of its own, which the first row then counts again
                n, m = bins.count(("a", 0)), max(bins)
                want = runs([b for b in bins if b != ("a", 0)], ("a", -1)) if m != ("a", 0) else {1: 0}
                want[1] = want.get(1, 0) - 1
                want[n] = want.get(n, 0) + (m != ("a", 0))
            assert got == {k: float(v) for k, v in want.items() if v > 0}
    assert coverage.coverage_histogram(df.where("false"), compat="reference").collect() == []
    with pytest.raises(ValueError, match="compat"):
        coverage.coverage_histogram(df, compat="other")
