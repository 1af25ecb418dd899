import json
import os
import random
import time
from collections import Counter

import numpy as np
import pytest

from tallywood.streaming import reorder


def plain(batches, reach):
    """One row after another into a sorted list; what leaves must not lie before what has left."""
    pending, frontier, out, late, last, open_ = Counter(), None, [], [], None, 0
    for batch in batches:
        for x in batch:
            if last is not None and x < last:
                late.append(x)
            else:
                pending[x] += 1
        came = [x for x in batch if last is None or x >= last]
        frontier = max([*came, *([] if frontier is None else [frontier])], default=None)
        for x in sorted(pending):
            if x + reach < frontier:
                if x != last:
                    if open_:
                        out.append((last, open_))
                    last, open_ = x, 0
                open_ += pending.pop(x)
    return out, late, last, open_, pending


def test_buffer_against_one_row_at_a_time():
    draw = random.Random(1)
    for _ in range(300):
        reach = draw.randrange(6)
        at, batches = 0, []
        for _ in range(draw.randrange(8)):
            batch = []
            for _ in range(draw.randrange(8)):
                at += draw.randrange(4)
                batch.append(max(0, at - draw.randrange(9)))
            batches.append(batch)
        buffer, out, late = reorder.Buffer(), [], []
        for batch in batches:
            behind = buffer.add(*np.unique(np.array(batch, np.int64), return_counts=True))
            late += np.repeat(*behind).tolist()
            out += zip(*(c.tolist() for c in buffer.leave(reach)), strict=True)
            buffer = reorder.Buffer(*buffer.state())
        want, want_late, last, open_, pending = plain(batches, reach)
        assert out == want and sorted(late) == sorted(want_late)
        rest = list(zip(*(c.tolist() for c in buffer.leave(None)), strict=True))
        assert rest == ([(last, open_ + pending.pop(last, 0))] if open_ else []) + sorted(pending.items())
        assert [len(c) for c in buffer.leave(None)] == [0, 0]
        if rest:
            assert buffer.add(np.array([rest[-1][0]]), np.array([1]))[0].tolist() == [rest[-1][0]]


def streamed(spark, folder, batches, reach, **options):
    """What the operator gives for batches of (chrom, bin), batch by batch."""
    own = reorder.session_with_state(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    stamp = time.time() - 1000
    for k, rows in enumerate(batches):
        path = f"{folder}/in/{k:03d}.json"
        with open(path, "w") as f:
            f.writelines(json.dumps({"chrom": c, "bin": x}) + "\n" for c, x in rows)
        os.utime(path, (stamp + k, stamp + k))
    stream = own.readStream.schema("chrom string, bin long").option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    out = reorder.in_order(stream, ["chrom"], "bin", reach, **options)
    seen = []
    q = out.writeStream.foreachBatch(lambda df, n: seen.append(df.collect())).option("checkpointLocation", f"{folder}/state").start()
    return q, seen


def arrivals(seed, reach, batches=5):
    """Rows in order of their bins but for a bounded disorder, dealt to batches."""
    draw = random.Random(seed)
    rows = []
    for chrom in ("a", "b", None):
        places = sorted(draw.randrange(80) for _ in range(150))
        # a row may come before rows up to half of the reach before it, and after as many
        rows += [(x + draw.randrange(reach // 2 + 1), chrom, x) for x in places]
    rows.sort(key=lambda r: r[0])
    size = -(-len(rows) // batches)
    return [[(c, x) for _, c, x in rows[k : k + size]] for k in range(0, len(rows), size)]


def test_bounded_disorder_gives_the_counts_of_all_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = arrivals(2, 10)
    batches[1].append(("a", None))
    q, seen = streamed(spark, tmp_path, batches, 10, idle=1500)
    try:
        # timers ask for batches without end, so no call says that all is done
        got, ends = [], time.time() + 90
        want = Counter((c, x) for rows in batches for c, x in rows if x is not None)
        while len(got) < len(want) and time.time() < ends:
            time.sleep(0.5)
            got = [r for rows in seen for r in rows]
    finally:
        q.stop()
    assert {(r.chrom, r.bin): r["count"] for r in got} == want and len(got) == len(want) and not any(r.late for r in got)
    for chrom in ("a", "b", None):
        places = [r.bin for r in got if r.chrom == chrom]
        assert places == sorted(places)


def test_late_rows_are_errors_or_marked(spark, tmp_path):
    batches = [[("a", 5), ("a", 9), ("b", 1)], [("a", 30), ("a", 8)], [("a", 40)], [("a", 8), ("a", 8), ("a", 29), ("b", 1)], [("a", 60)]]
    for k, options in enumerate([{"late": "mark"}, {}]):
        folder = tmp_path / str(k)
        (folder / "in").mkdir(parents=True)
        q, seen = streamed(spark, folder, batches, 5, **options)
        try:
            if options:
                q.processAllAvailable()
                got = [(r.chrom, r.bin, r["count"], r.late) for rows in seen for r in rows]
                assert got == [("a", 5, 1, False), ("a", 8, 1, False), ("a", 9, 1, False), ("a", 8, 2, True), ("a", 29, 1, True), ("a", 30, 1, False)]
            else:
                with pytest.raises(Exception, match="give a longer reach"):
                    q.processAllAvailable()
        finally:
            q.stop()
    with pytest.raises(ValueError):
        reorder.in_order(None, ["chrom"], "bin", 5, late="drop")


def test_reach_covers_the_widest_interval():
    draw = random.Random(3)
    for _ in range(200):
        size, width = draw.randrange(1, 20), draw.randrange(1, 60)
        reach = reorder.reach_of_bins(size, width)
        starts = sorted(draw.randrange(300) for _ in range(40))
        seen = -1
        for s in starts:
            first, last = s // size, (s + draw.randrange(1, width + 1) - 1) // size
            assert first >= seen - reach
            seen = max(seen, last)
