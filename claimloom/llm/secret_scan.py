"""Secret scans by a randomness test battery, in DataFrame functions only.

Base kinds are the patterns ``assign``, ``access`` and ``hex``. Beside them, every
run of at least ``min_length`` characters of a base64-like alphabet with a letter and
a digit is a candidate of kind ``random``. Its encoding is inferred (hex, base32,
alphanumeric, base64) and its character indices are tested:

* chi-squared: is the count of each symbol consistent with a uniform alphabet;
* runs above and below the middle of the alphabet (Wald-Wolfowitz);
* lag-one serial correlation.

A candidate that fails one of the three (two-sided level ``alpha``) is not random.
Those that pass get a p-value against ordinary text: the count of equal symbol pairs
(the chi-squared statistic up to a constant) under text's coincidence rate, times the
chance that text keeps to a narrow alphabet. Benjamini-Hochberg control at ``fdr``
runs within strata of token length. The p-values of all documents are counted
in logarithmic bins first, each rounded up to its bin's edge, so that the only thing
gathered is a strata-by-bins table of fixed size and the control stays conservative.

Defined results: null text is empty text; every row is scanned on its own, repeated
rows alike; texts of any length are scanned whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.plans.staging import stage

#: Fixed by the contract: the kinds in the order in which ties are listed.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: Alphabets from the narrowest: name, pattern of the whole token, order of its symbols, and the share of text that such symbols make.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef", 0.30),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.75),
    ("alphanumeric", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.95),
    ("base64", r"^.+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 1.0),
)
#: Sums of squared and cubed symbol frequencies of ordinary text.
TEXT_PAIRS, TEXT_TRIPLES = 0.065, 0.0055
#: Bins a decade of p, and decades that are told apart.
BINS_PER_DECADE, DECADES = 50, 40
STRATUM = 16


SPANS = "array<struct<start:int,rank:int,end:int,kind:string,token:string>>"


#: Elements of an array that are folded together; arrays of n elements cost about n * CHUNK + (n / CHUNK) ** 2.
CHUNK = 128


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often, and within which function, the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _chunks(array: Column) -> Column:
    """An array that isn't empty as an array of its ``CHUNK`` elements each."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / CHUNK).cast("int")), lambda c: F.slice(array, c * CHUNK + 1, F.lit(CHUNK)))


def _running(values: Column, join, zero: Column) -> Column:
    """What ``join`` (associative) makes of all elements before each one of an array of integers, ``zero`` for the first.

    Appending to an array copies it, so elements are folded in chunks, and chunks by their totals.
    """

    def before(array: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(array, state, lambda done, v: F.struct(join(done["at"], v).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")))["out"]

    def folded(chunks: Column) -> Column:
        return F.flatten(F.zip_with(chunks, before(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda x, y: join(x, y))), zero), before))

    none = F.array().cast("array<int>")
    return _let(values, lambda all_: F.when(F.size(all_) == 0, none).otherwise(_let(_chunks(all_), folded)))


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as ``(start, rank, end, kind, token)``; ``keep`` decides after matching.

    What stands between the matches gives their places: a running sum of lengths.
    """
    none = F.array().cast(SPANS)
    # one piece more than matches: the last pair has no match
    pairs = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("gap")), lambda p: p["m"].isNotNull())

    def placed(all_: Column) -> Column:
        before = _running(F.transform(all_, lambda p: F.char_length(p["m"]) + F.char_length(p["gap"])), lambda x, y: x + y, F.lit(0))
        return F.zip_with(all_, before, lambda p, at: span(p["m"], at + F.char_length(p["gap"])))

    def span(token: Column, start: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.char_length(token)).alias("end"), F.lit(kind).alias("kind"), token.alias("token"))

    return F.when(F.rlike(text, F.lit(pattern)), F.filter(_let(pairs, placed), lambda s: keep(s["token"])).cast(SPANS)).otherwise(none)


def _apart(maybe: Column, base: Column) -> Column:
    """The spans of ``maybe`` that overlap none of ``base``: by start, each lies behind all that begin before it and before the next that begins."""
    far = F.lit(2**31 - 1)
    is_base = lambda s: s["rank"] < KINDS.index("random")

    def kept(every: Column) -> Column:
        behind = _running(F.transform(every, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), F.greatest, F.lit(0))
        ahead = F.reverse(_running(F.reverse(F.transform(every, lambda s: F.when(is_base(s), s["start"]).otherwise(far))), F.least, far))
        placed = F.arrays_zip(every.alias("span"), behind.alias("behind"), ahead.alias("ahead"))
        free = F.filter(placed, lambda p: ~is_base(p["span"]) & (p["behind"] <= p["span"]["start"]) & (p["ahead"] >= p["span"]["end"]))
        return F.transform(free, lambda p: p["span"])

    return F.when((F.size(base) == 0) | (F.size(maybe) == 0), maybe).otherwise(_let(F.array_sort(F.concat(base, maybe)), kept))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the Abramowitz-Stegun rational form 26.2.17 (error below 1e-7) and the Mills ratio far out."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    density = F.exp(-a * a / 2) / 2.5066282746310002
    near = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.when(a < 6, near).otherwise(density / a * (1 - 1 / (a * a)))
    return F.when(z >= 0, upper).otherwise(1 - upper)


def tested(candidates: DataFrame, alpha: float) -> DataFrame:
    """Adds the tests' p-values to rows with a ``token``, and ``passes``: no test of randomness rejects it at ``alpha``."""
    core = F.translate(F.regexp_replace("token", "=+$", ""), "-_", "+/")
    which = F.coalesce(*[F.when(F.rlike(core, F.lit(pattern)), F.lit(i)) for i, (_, pattern, _, _) in enumerate(ENCODINGS)])
    out = candidates.withColumn("core", core).withColumn("enc", which)

    def pick(values):
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("enc"))

    out = (
        out.withColumn("encoding", pick([name for name, *_ in ENCODINGS]))
        .withColumn("symbols", pick([alphabet for _, _, alphabet, _ in ENCODINGS]))
        .withColumn("chars", F.split(F.when(F.col("enc") == 0, F.lower("core")).otherwise(F.col("core")), "(?!^)(?!$)"))
        .withColumn("xs", F.transform("chars", lambda c: F.instr(F.col("symbols"), c).cast("double") - 1))
        .withColumn("n", F.size("xs").cast("double"))
        .withColumn("k", F.length("symbols").cast("double"))
    )
    squares = F.aggregate(F.transform(F.array_distinct("xs"), lambda s: F.pow(F.size(F.filter("xs", lambda x: x == s)).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    middle = (F.col("k") - 1) / 2
    highs = F.aggregate("xs", F.lit(0.0), lambda a, x: a + F.when(x > middle, 1.0).otherwise(0.0))
    follow = F.zip_with(F.slice("xs", F.lit(1), F.size("xs") - 1), F.slice("xs", F.lit(2), F.size("xs") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    changes = F.aggregate(follow, F.lit(0.0), lambda s, p: s + F.when((p["a"] > middle) != (p["b"] > middle), 1.0).otherwise(0.0))
    mean = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    out = out.withColumns({"sq": squares, "high": highs, "turns": changes, "mean": mean})
    spread = F.aggregate("xs", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    lagged = F.aggregate(follow, F.lit(0.0), lambda s, p: s + (p["a"] - F.col("mean")) * (p["b"] - F.col("mean")))
    out = out.withColumns({"spread": spread, "lagged": lagged})
    n, k, h = F.col("n"), F.col("k"), F.col("high")
    chi = F.col("sq") * k / n - n
    # a chi-squared variable is near normal by its cube root (Wilson and Hilferty)
    df = k - 1
    z_chi = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    expected = 2 * h * (n - h) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when(variance > 0, (F.col("turns") + 1 - expected) / F.sqrt(F.greatest(variance, F.lit(1e-12)))).otherwise(F.lit(99.0))
    z_serial = F.when(F.col("spread") > 0, (F.col("lagged") / F.greatest(F.col("spread"), F.lit(1e-12)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
    pairs, seen = n * (n - 1) / 2, (F.col("sq") - n) / 2
    sd = F.sqrt(pairs * (TEXT_PAIRS - TEXT_PAIRS**2) + n * (n - 1) * (n - 2) * (TEXT_TRIPLES - TEXT_PAIRS**2))
    narrow = F.pow(pick([share for *_, share in ENCODINGS]), n)
    return out.withColumns(
        {
            "p_chi": _normal_tail(z_chi),
            "p_runs": 2 * _normal_tail(F.abs(z_runs)),
            "p_serial": 2 * _normal_tail(F.abs(z_serial)),
            "p_text": F.greatest(_normal_tail((pairs * TEXT_PAIRS - seen) / sd) * narrow, F.lit(10.0**-DECADES)),
        }
    ).withColumn("passes", (F.col("p_chi") > alpha) & (F.col("p_runs") > alpha) & (F.col("p_serial") > alpha))


def thresholds(tests: DataFrame, fdr: float) -> DataFrame:
    """``(stratum, cut)``: the largest bin of p-values that Benjamini-Hochberg keeps in each length stratum."""
    counted = tests.groupBy("stratum", "bin").agg(F.count("*").alias("n"), F.sum(F.col("passes").cast("long")).alias("good"))
    by = Window.partitionBy("stratum")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"rank": F.sum("good").over(upto), "tests": F.sum("n").over(by)})
    edge = F.pow(F.lit(10.0), F.col("bin") / BINS_PER_DECADE)
    return ranked.where(edge * F.col("tests") <= fdr * F.col("rank")).groupBy("stratum").agg(F.max("bin").alias("cut"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 20, alpha: float = 0.001, fdr: float = 0.01) -> DataFrame:
    """``(doc_id, key, base, spans)`` of each row: its base spans, and these with the ``random`` ones, by start.

    A span is ``(start, rank, end, kind, token)`` in code points, end exclusive;
    ``key`` is a hash of the text, so that different texts under one id stay apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    long_run = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{min_length},}}={{0,2}}"
    base = F.concat(
        _spans(text, ASSIGN, "assign", lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
        _spans(text, ACCESS, "access", lambda m: F.lit(True)),
        _spans(text, HEX, "hex", lambda m: F.lit(True)),
    )
    maybe = _spans(text, long_run, "random", lambda m: F.rlike(m, F.lit("[A-Za-z]")) & F.rlike(m, F.lit("[0-9]")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # written once: a filter on what the patterns find would run them again
    found = stage(rows.select("doc_id", F.xxhash64("text").alias("key"), F.array_sort(base).alias("base"), maybe.alias("maybe")), "secret-candidates").df
    apart = _apart(F.col("maybe"), F.col("base"))
    candidates = found.where(F.size("maybe") > 0).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", F.explode(apart).alias("span"))
    scored = tested(candidates.withColumn("token", F.col("span.token")), alpha).select(
        "doc_id",
        "key",
        "span",
        "passes",
        F.least(F.floor(F.length("token") / STRATUM), F.lit(16)).cast("int").alias("stratum"),
        F.ceil(F.log10("p_text") * BINS_PER_DECADE).cast("int").alias("bin"),
    )
    tests = stage(scored, "secret-tests").df
    # at most 17 strata, so this side is tiny
    kept = tests.where("passes").join(F.broadcast(thresholds(tests, fdr)), "stratum").where("bin <= cut")
    more = kept.groupBy(F.col("doc_id").alias("more_id"), F.col("key").alias("more_key")).agg(F.collect_list("span").alias("more"))
    joined = found.join(more, F.col("doc_id").eqNullSafe(F.col("more_id")) & (F.col("key") == F.col("more_key")), "left")
    return joined.select("doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPANS)))).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mask`` (overlapping spans by one), and ``n_chars`` to match."""
    found = secret_spans(docs, **options).where(F.size("spans") > 0).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "spans")
    same = F.col("all.doc_id").eqNullSafe(F.col("found.doc_id")) & (F.xxhash64("all.text") == F.col("found.key"))
    scanned = docs.alias("all").join(found.alias("found"), same, "left")
    was, spans = F.col("all.text"), F.coalesce(F.col("found.spans"), F.array().cast(SPANS))
    # what stands before each span and after the last; a span that begins inside those before it leaves nothing, and no second mask
    reached = _running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))

    def masked(chunk: Column) -> Column:
        # spans stand by start: the chunk's stretch is cut out once, and its parts from there
        start, end = F.get(chunk, 0)["reached"], F.element_at(chunk, -1)["start"]

        def parts(stretch: Column) -> Column:
            part = lambda p: F.concat(F.substring(stretch, p["reached"] - start + 1, p["start"] - p["reached"]), F.lit(mask))
            return F.array_join(F.transform(chunk, lambda p: F.when(p["start"] >= p["reached"], part(p)).otherwise(F.lit(""))), "")

        return _let(F.substring(was, start + 1, F.greatest(end - start, F.lit(0))), parts)

    places = F.zip_with(spans, reached, lambda s, r: F.struct(s["start"].alias("start"), r.alias("reached")))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    changed = F.size(spans) > 0
    text = F.when(changed, F.concat(_let(places, lambda all_: F.array_join(F.transform(_chunks(all_), masked), "")), F.substring(was, last + 1, F.char_length(was)))).otherwise(was)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("all.n_chars"))
    return scanned.select(*[new.get(c, F.col(f"all.`{c}`")).alias(c) for c in docs.columns])


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[count(kind) for kind in KINDS[:3]], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
