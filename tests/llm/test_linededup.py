import hashlib
import random

import pytest

from tallywood.llm import linededup

SCHEMA = "doc_id long, text string, place int, chunk string"


def chunks(text):
    lines = text.split("\n")
    md5 = [hashlib.md5(x.encode()).hexdigest() for x in lines]
    out, begin = [], 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or (i > 1 and hashlib.md5((md5[i - 2] + md5[i - 1]).encode()).hexdigest()[0] in linededup.ENDS):
            out.append(lines[begin:i])
            begin = i
    return out


def brute(rows):
    seen, out = {}, []
    key = lambda i: (1 << 63) - 1 if i is None else i
    cut = [(key(i), t, [] if t is None else chunks(t)) for i, t in rows]
    for i, _, parts in sorted(cut, key=lambda x: x[0]):
        for k, c in enumerate(parts):
            if len(c) >= linededup.LINES and len("\n".join(c)) >= linededup.CHARS:
                at = seen.setdefault("\n".join(c), (i, k))
                seen["\n".join(c)] = min(at, (i, k))
    for i, t, parts in cut:
        gone = {k for k, c in enumerate(parts) if seen.get("\n".join(c), (i, k)) != (i, k) and len(c) >= linededup.LINES}
        out.append((t if not gone else "\n".join(x for k, c in enumerate(parts) if k not in gone for x in c), sum(len(parts[k]) for k in gone)))
    return out


def test_as_brute_force(spark):
    rng = random.Random(0)
    line = lambda: "".join(rng.choices("abc é", k=rng.randint(0, 30)))
    passages = [[line() for _ in range(rng.randint(3, 12))] for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [[line() for _ in range(rng.randint(0, 6))] for _ in range(4)]
        for p in rng.sample(passages, 2):
            parts.insert(rng.randrange(5), p)
        texts.append("\n".join(x for p in parts for x in p))
    texts += [None, "", "\n", "\n\n\n", texts[0], texts[0], "one line only", "same long line of text, same long line\n" * 4000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (3, texts[3])]
    got = linededup.remove_repeated_lines(spark.createDataFrame([(i, t, 9, "x") for i, t in rows], SCHEMA)).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    mine = sorted(((r.doc_id, r.text, r.removed_lines) for r in got), key=order)
    want = sorted(((i, t, n) for (i, _), (t, n) in zip(rows, brute(rows), strict=True)), key=order)
    assert mine == want and sum(n > 0 for _, _, n in want) > 30
    assert got[0].place == 9 and got[0].chunk == "x"


def test_an_inserted_line_moves_no_other_boundary():
    rng = random.Random(1)
    lines = [f"line {rng.random()}" for _ in range(200)]
    one, two = chunks("\n".join(lines)), chunks("\n".join([*lines[:50], "inserted", *lines[50:]]))
    assert len({"\n".join(c) for c in one} - {"\n".join(c) for c in two}) <= 2


@pytest.mark.parametrize("rows", [[], [(1, None, 0, "")]])
def test_nothing_to_remove(spark, rows):
    got = linededup.remove_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.text, r.removed_lines) for r in got] == [(None, 0)] * len(rows)


def test_rows_of_one_id_or_of_none_lose_only_their_own_chunks(spark):
    rng = random.Random(3)
    lines = lambda n: [f"a line of words {rng.random()}" for _ in range(n)]
    passages = [lines(rng.randint(4, 9)) for _ in range(5)]
    rows = [(1, "\n".join(x for p in passages[:2] for x in p))]
    for k in range(40):
        parts = [lines(rng.randint(0, 9)) for _ in range(rng.randint(1, 6))] + [passages[k % 5]]
        rng.shuffle(parts)
        rows.append((rng.choice([None, 2, 3]), "\n".join(x for p in parts for x in p)))
    rows += [(None, rows[5][1]), (None, rows[5][1]), (3, "short"), (None, "short"), (2, None), (None, None)]
    table = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], SCHEMA)
    names = {r.text: r.part for r in table.selectExpr("text", "xxhash64(text) as part").collect()}
    place = lambda i, t, k: (1 << 63, names[t], k) if i is None else (i, 0, k)
    ok = lambda c: len(c) >= linededup.LINES and len("\n".join(c)) >= linededup.CHARS
    first = {}
    for i, t in rows:
        for k, c in enumerate(chunks(t) if t is not None else []):
            first["\n".join(c)] = min(first.get("\n".join(c), (1 << 64,)), place(i, t, k))
    want = []
    for i, t in rows:
        parts = chunks(t) if t is not None else []
        gone = {k for k, c in enumerate(parts) if ok(c) and first["\n".join(c)] != place(i, t, k)}
        want.append((i, t if not gone else "\n".join(x for k, c in enumerate(parts) if k not in gone for x in c), sum(len(parts[k]) for k in gone)))
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    got = [(r.doc_id, r.text, r.removed_lines) for r in linededup.remove_repeated_lines(table).collect()]
    assert sorted(got, key=order) == sorted(want, key=order) and sum(n > 0 for _, _, n in want) > 15
