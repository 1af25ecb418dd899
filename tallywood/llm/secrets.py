"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests can't tell from random.

Everything is DataFrame functions. A text is split by each pattern, so that the lengths of the pieces
give the places of the matches. Tokens get tests of runs of kinds of characters, which leave out
identifiers of words and numbers, then chi-squared uniformity, runs and serial-correlation tests, in
the encoding that their characters suggest; as many decoys, stretches of the plain text before
the tokens of the same length tested in the same encoding, set the threshold for each encoding and
range of lengths so that the share of decoys among what passes is controlled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywood.llm import _shared

# The kinds of spans in order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
PATTERNS = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    r"(AKIA[A-Z0-9]{16,})",
    r"([0-9a-f]{24,})",
    r"([A-Za-z0-9+/_-]{16,})",
)
#: An assigned value has so many characters at least.
ASSIGNED = 6
# Alphabets of encodings, the first whose characters a token is made of is taken.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")
#: Upper ends of the ranges of lengths that have their own thresholds.
LENGTHS = (23, 31, 47, 95)
#: Most decoys for each token that passes, least combined probability, and steps of probability.
FALSE_SHARE, LEAST, STEPS = 0.05, 0.01, 50
#: Least probability of as few changes between kinds of characters, and of as long a run of digits. Identifiers made of words and numbers have few and long ones.
LEAST_CHANGES, LEAST_DIGITS = 0.06, 0.002


def _matches(text: Column, kind: int) -> Column:
    """``array<struct<kind, nth, gap, match, fine, before>>``: matches with the lengths of the pieces before them."""
    pattern = F.lit(PATTERNS[kind])
    pieces, found, value = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(1))
    # the piece after the last match has no match: both arrays of matches are shorter by it
    parts = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), F.arrays_zip(found.alias("m"), value.alias("v")), lambda p, x: F.struct(p.alias("p"), x["m"].alias("m"), x["v"].alias("v")))
    before = lambda x: F.right(F.regexp_replace(F.right(x["p"], F.length(x["m"]) * 3 + 30), "[^A-Za-z0-9+/_-]", ""), F.length(x["m"])) if kind == 3 else F.lit("")
    row = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["p"]).alias("gap"), x["m"].alias("match"), (F.length(x["v"]) >= (ASSIGNED if kind == 0 else 1)).alias("fine"), before(x).alias("before"))
    return F.when(text.rlike(PATTERNS[kind]), F.transform(parts, row)).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,match:string,fine:boolean,before:string>>"))


def _tail(z: Column) -> Column:
    """The share of a normal distribution above ``z``, to about three digits."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def encoding(t: Column) -> Column:
    """The first alphabet that has all characters of ``t``; null if none has."""
    return F.coalesce(*(F.when(t.rlike(f"^[{a}]+$" if "-" not in a else "^[A-Za-z0-9+/_-]+$"), F.lit(a)) for a in ALPHABETS))


def _kinds_of(alphabet: str) -> list[float]:
    """The shares of digits, small letters, capitals and signs in an alphabet."""
    each = [sum(map(kind, alphabet)) for kind in (str.isdigit, str.islower, str.isupper)]
    return [n / len(alphabet) for n in (*each, len(alphabet) - sum(each))]


def with_structure(rows: DataFrame, token: str, changes: str, digits: str) -> DataFrame:
    """``rows`` with the probabilities that a random token of the same encoding changes as seldom between kinds of characters, and has as long a run of digits.

    A normal approximation to the number of changes (their mean and spread for independent
    characters), and the expected number of runs of digits of at least the longest. Null for a token
    of under 2 characters or of others than the encodings have.
    """
    t = F.col(token)
    steps = rows.withColumn("_alphabet", F.when(F.length(t) > 1, encoding(t)))
    signs = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[0-9]", "0"), "[+/_-]", "-"), "[A-Z]", "A"), "[a-z]", "a")
    steps = steps.withColumn("_n", F.length(t).cast("double")).withColumn("_signs", signs)
    # a run of one kind is what another kind ends
    same = F.size(F.regexp_extract_all("_signs", F.lit("(0+|a+|A+|-+)"), F.lit(1))).cast("double") - 1
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("_signs", F.lit("(0+)"), F.lit(1)), lambda x: F.length(x))), F.lit(0)).cast("double")
    mean, both, share = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for alphabet in ALPHABETS:
        of, here = _kinds_of(alphabet), F.col("_alphabet") == alphabet
        mean, both, share = (F.when(here, F.lit(x)).otherwise(y) for x, y in ((1 - sum(x * x for x in of), mean), (sum(x * (1 - x) ** 2 for x in of), both), (of[0], share)))
    n = F.col("_n")
    spread = F.sqrt((n - 1) * mean * (1 - mean) + 2 * (n - 2) * (both - mean * mean))
    steps = steps.withColumn("_few", _tail(((n - 1) * mean - same - 0.5) / spread))
    steps = steps.withColumn("_long", F.least(F.lit(1.0), F.pow(share, longest) * (1 + (n - longest) * (1 - share))))
    known = F.col("_alphabet").isNotNull()
    return steps.select(*rows.columns, F.when(known, F.col("_few")).alias(changes), F.when(known, F.col("_long")).alias(digits))


def with_randomness(rows: DataFrame, token: str, out: str, like: str | None = None) -> DataFrame:
    """``rows`` and ``out``: the probability, 0 to 1, that a random token of the same encoding looks no more random.

    The encoding is that of the column ``like`` (else of the token); a token of other characters has null.

    Three tests (uniformity of characters by chi-squared, runs about the middle of the alphabet, and
    correlation of neighbours), combined by Fisher's method. Null for a token of under 2 characters
    or of others than the encodings have.
    """
    # each step is a column of its own, so that what a lambda looks up is made once for a token
    t = F.col(token)
    alphabet = encoding(F.col(like or token))
    steps = rows.withColumn("_alphabet", F.when(F.length(t) > 1, alphabet)).withColumn("_size", F.length("_alphabet").cast("double"))
    steps = steps.withColumn("_chars", F.filter(F.split(t, ""), lambda c: c != ""))
    values = F.transform("_chars", lambda c: F.instr(F.col("_alphabet"), c).cast("double") - 1)
    steps = steps.withColumn("_values", F.when(F.col("_alphabet").isNotNull(), values))
    steps = steps.withColumn("_values", F.when(~F.exists("_values", lambda x: x < 0), F.col("_values")))
    squares = F.aggregate(F.array_distinct("_values"), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter("_values", lambda x: x == c)).cast("double"), F.lit(2.0)))
    start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("high"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("own"), F.lit(0.0).alias("next"))

    def step(a: Column, x: Column) -> Column:
        first, up, was = a["last"] < 0, x >= F.col("_size") / 2, a["last"] >= F.col("_size") / 2
        return F.struct(
            x.alias("last"), (a["turns"] + F.when(first | (up != was), 1.0).otherwise(0.0)).alias("turns"), (a["high"] + up.cast("double")).alias("high"),
            (a["sum"] + x).alias("sum"), (a["own"] + x * x).alias("own"), (a["next"] + F.when(first, 0.0).otherwise(a["last"] * x)).alias("next"),
        )

    steps = steps.withColumn("_squares", squares).withColumn("_fold", F.aggregate("_values", start, step))
    size, squares, fold, n = F.col("_size"), F.col("_squares"), F.col("_fold"), F.col("_n")
    steps = steps.withColumn("_n", F.size("_values").cast("double")).withColumn("_first", F.get("_values", F.lit(0)))
    # chi-squared, by the cube-root approximation to a normal variable
    k = size - 1
    steps = steps.withColumn("_chi", _tail((F.pow(F.greatest(size / n * squares - n, F.lit(0.0)) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))))
    mean, spread, m, own = F.col("_mean"), F.col("_spread"), F.col("_m"), F.col("_own")
    steps = steps.withColumn("_mean", 2 * fold["high"] * (n - fold["high"]) / n + 1).withColumn("_spread", F.sqrt((mean - 1) * (mean - 2) / (n - 1)))
    steps = steps.withColumn("_runs", F.when(spread > 0, 2 * _tail(F.abs(fold["turns"] - mean) / spread)).otherwise(0.0))
    steps = steps.withColumn("_m", fold["sum"] / n).withColumn("_own", fold["own"] - n * m * m)
    shared = fold["next"] - m * (2 * fold["sum"] - F.col("_first") - fold["last"]) + (n - 1) * m * m
    steps = steps.withColumn("_serial", F.when(own > 1e-9, 2 * _tail(F.abs(shared / F.nullif(own, F.lit(0.0)) + 1 / n) * F.sqrt(n))).otherwise(0.0))
    steps = steps.withColumn("_half", -sum(F.log(F.greatest(F.col(p), F.lit(1e-30))) for p in ("_chi", "_runs", "_serial")))
    half = F.col("_half")
    return steps.select(*rows.columns, F.when(F.col("_values").isNotNull(), F.exp(-half) * (1 + half + half * half / 2)).alias(out))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, kind, start, stop, match, before, fine``: all matches; a text without any has one row of nulls."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = own.select("row", "doc_id", F.inline_outer(F.concat(*(_matches(F.col("text"), k) for k in range(len(KINDS))))))
    rows = rows.repartition("row")
    stop = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("row", "kind").orderBy("nth"))
    rows = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("match"))
    return rows.where("kind is null or fine or kind = 0")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<start, kind, stop, match>>`` for every row of ``docs``, in order.

    Places count code points, the end exclusive. ``kind`` is the place in KINDS: what the first three
    patterns match always counts (an assigned value of 6 characters at least); ``random`` are tokens of 16
    or more characters, with letters and digits, that pass the tests and lie in no span of a fixed pattern.
    Tests of runs come first: of changes between kinds of characters, and of the longest run of digits.
    Tokens of letters alone, or with other characters than the encodings have, are no candidates. A null text counts as empty; rows with one id stay
    apart. An empty table gives no rows.
    """
    rows = _shared.cut(_spans(docs, id_col, text_col))
    tokens = rows.where((F.col("kind") == 3) & F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Za-z]"))
    length = sum((F.length("match") > end).cast("int") for end in LENGTHS)
    both = F.array(F.struct(F.lit(0).alias("fake"), F.col("match").alias("token")), F.struct(F.lit(1).alias("fake"), F.col("before").alias("token")))
    # identifiers of words and numbers look random to the other tests, so they go before decoys are drawn
    tokens = with_structure(tokens, "match", "few", "long").where((F.col("few") >= LEAST_CHANGES) & (F.col("long") >= LEAST_DIGITS))
    tokens = tokens.select("row", "doc_id", "kind", "start", "stop", "match", F.concat_ws(" ", encoding(F.col("match")), length.cast("string")).alias("range"), F.inline(both)).where("fake = 0 or length(token) = length(match)")
    # a decoy is held against the encoding of its token, as chance would have to make one of those
    tokens = with_randomness(tokens, "token", "p", like="match").withColumn("p", F.coalesce("p", F.lit(0.0)))
    tokens = _shared.cut(tokens.withColumn("step", F.least(F.floor(F.col("p") * STEPS), F.lit(STEPS - 1)).cast("int")))
    counts = tokens.groupBy("range", "step").agg(F.sum(1 - F.col("fake")).alias("token"), F.sum("fake").alias("fake"))
    up = Window.partitionBy("range").orderBy(F.desc("step"))
    passed = counts.withColumn("t", F.sum("token").over(up)).withColumn("f", F.sum("fake").over(up)).where(F.col("f") <= FALSE_SHARE * F.col("t"))
    least = passed.groupBy("range").agg(F.min("step").alias("least"))  # a row for each encoding and range of lengths
    random = tokens.where("fake = 0").join(F.broadcast(least), "range").where((F.col("step") >= F.col("least")) & (F.col("p") >= LEAST))
    span = F.struct("start", "kind", "stop", "match")
    base = rows.select("row", "doc_id", F.when(F.col("kind").isin(0, 1, 2) & F.col("fine"), span).alias("span"))
    both = base.union(random.select("row", "doc_id", span.alias("span")))
    found = both.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    # what a fixed pattern found already isn't added a second time
    fixed = F.filter("spans", lambda s: s["kind"] < 3)
    fresh = lambda s: (s["kind"] < 3) | ~F.exists("fixed", lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"]))
    return found.withColumn("fixed", fixed).select("doc_id", F.filter("spans", fresh).alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_shared.table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))
    many = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = joined(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", many(0).alias("n_assign"), many(1).alias("n_access"), many(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), many(3).alias("n_random"))
