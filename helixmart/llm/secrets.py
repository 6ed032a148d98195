"""Secret scans with DataFrame functions only: base patterns, and a battery of randomness tests.

The battery looks at tokens of code-like characters, infers the encoding they could have (hex, base32, base64)
and tests whether the characters look drawn at random: a chi-squared test of equal use of the alphabet, a runs
test between letters and the rest of the alphabet, and a lag-1 serial correlation. How words fare in the three tests is fitted on
the corpus' own words (numbers, for hex): their index of coincidence gives mean and spread of chi-squared at any length,
their moments those of the other two. A token's p-value says how likely a word comes out as random as this in all three,
each weighed by how far it parts words from random codes; the p-values of the whole corpus go through a false-discovery
control within bands of length, since short tokens carry less evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixmart.llm.common import stored, table

# Fixed values of the base patterns: (kind, pattern, group whose length counts, least length).
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Tokens that the battery tests: maximal runs of these characters, at least so long.
TOKEN = r"[A-Za-z0-9+/_-]{16,}=*"
#: encoding -> (what a token must be made of, its alphabet in order).
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base64": (r"^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: Level of the false-discovery control, and level at which a single test tells that a token is not random.
FDR, REJECT_Z = 0.01, 3.3
#: The same for too few runs, where words and identifiers lie, and the score of a token that uses one part only.
FEW_RUNS, ONE_PART = -2.33, 99.0
#: encoding -> (index of coincidence, mean and deviation of the squared runs score, the same of the serial one) of words
#: where a corpus holds fewer than LEAST_WORDS to fit them on: letter frequencies of European languages, decimal digits.
WORDS_LIKE = {"hex": (0.1, 100.0, 10.0, 1.0, 1.4), "base32": (0.066, 1.0, 1.4, 1.0, 1.4), "base64": (0.06, 1.0, 1.4, 1.0, 1.4)}
LEAST_WORDS = 100
#: Shortest lengths of the bands in which discoveries are counted.
BANDS = [16, 20, 24, 32, 48, 64, 128]
#: p-values are counted in steps of this many powers of ten.
P_STEP, P_LAST = 0.1, 600


#: Elements that a running total copies at a time; totals of blocks are carried on top.
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """array<int> -> for each element what ``combine`` (a sum, a maximum; from 0) makes of those before it. Growing one array
    by each element would copy it every time; blocks keep that to BLOCK elements, so long arrays take linear time."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))

    def within(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return F.transform(blocks, lambda block: F.aggregate(block, zero, step))

    def across(parts: Column) -> Column:
        starts = F.aggregate(parts, zero, lambda acc, x: step(acc, x["at"]), lambda acc: acc["all"])
        return F.flatten(F.zip_with(parts, starts, lambda x, start: F.transform(x["all"], lambda a: combine(start, a))))

    return bound(values, lambda v: bound(within(v), across))


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start,no,end,hit>> of leftmost non-overlapping matches; positions are code points, the end is
    exclusive. What lies between the matches gives their places, so the text is cut once and never per position."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    order = [k for k, *_ in BASE].index(kind) if kind in [k for k, *_ in BASE] else len(BASE)

    def placed(pairs: Column) -> Column:
        ahead = before(F.transform(pairs, lambda p: p["gap"] + F.length(p["hit"])), lambda a, b: a + b)
        return F.zip_with(pairs, ahead, lambda p, at: F.struct(
            (at + p["gap"]).alias("start"), F.lit(order).alias("no"), (at + p["gap"] + F.length(p["hit"])).alias("end"), p["hit"].alias("hit")))

    pairs = F.zip_with(between, found, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    # There is one piece more than matches.
    spans = bound(F.filter(pairs, lambda p: p["hit"].isNotNull()), placed)
    return F.filter(spans, lambda s: F.length(F.regexp_extract(s["hit"], pattern, group)) >= least)


def _count(token: Column, character: str) -> Column:
    return F.length(token) - F.length(F.replace(token, F.lit(character), F.lit("")))


def measured(token: Column) -> Column:
    """Struct of a token's inferred encoding, its alphabet's size, length, sum of squared counts, chi-squared, and z-scores of
    the three tests (against random characters)."""
    body = F.rtrim(F.translate(token, "=", " "))
    name = F.when(body.rlike(ENCODINGS["hex"][0]), "hex").when(body.rlike(ENCODINGS["base32"][0]), "base32").otherwise("base64")
    return bound(F.struct(body.alias("body"), name.alias("encoding")), _tested)


def _tested(token: Column) -> Column:
    alphabet = F.element_at(F.create_map(*[F.lit(x) for e, (_, letters) in ENCODINGS.items() for x in (e, letters)]), token["encoding"])
    flat = F.when(token["encoding"] == "hex", F.lower(token["body"])).when(token["encoding"] == "base32", token["body"]).otherwise(
        F.translate(token["body"], "-_", "+/"))
    squares = reduce(lambda a, b: a + b, [F.pow(_count(flat, c).cast("double"), F.lit(2.0)) for c in ENCODINGS["base64"][1]])
    places = F.filter(F.transform(F.split(flat, ""), lambda c: F.instr(alphabet, c).cast("double")), lambda x: x > 0)
    counted = F.struct(token["encoding"].alias("encoding"), F.length(flat).cast("double").alias("n"), F.length(alphabet).cast("double").alias("size"),
                       squares.alias("squares"), places.alias("places"))
    return bound(counted, _scores)


def _scores(c: Column) -> Column:
    n, size, places = c["n"], c["size"], c["places"]
    # Chi-squared of equal use, as a standard normal by Wilson and Hilferty.
    chi, df = c["squares"] * size / n - n, size - 1
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # The two parts of the alphabet are its letters (small ones, where there are both) and the rest: random codes mix them,
    # identifiers string them together.
    low = F.when(c["encoding"] == "hex", F.lit(10)).when(c["encoding"] == "base32", F.lit(0)).otherwise(F.lit(26))
    high = F.when(c["encoding"] == "hex", F.lit(16)).when(c["encoding"] == "base32", F.lit(26)).otherwise(F.lit(52))
    half = F.transform(places, lambda x: ((x > low) & (x <= high)).cast("int"))
    less = F.greatest(F.size(places) - 1, F.lit(0))
    shifted = F.slice(places, F.lit(2), less)

    def runs(h: Column) -> Column:
        ones = F.aggregate(h, F.lit(0), lambda a, x: a + x).cast("double")
        changes = F.aggregate(F.zip_with(F.slice(h, F.lit(1), less), F.slice(h, F.lit(2), less), lambda a, b: (a != b).cast("int")),
                              F.lit(0), lambda a, x: a + x).cast("double")
        mean = 2 * ones * (n - ones) / n + 1
        var = (mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0))
        return F.when(var > 0, (changes + 1 - mean) / F.sqrt(var)).otherwise(F.lit(ONE_PART))

    centre, spread = (size + 1) / 2, (size * size - 1) / 12
    serial = F.aggregate(F.zip_with(places, shifted, lambda a, b: F.coalesce((a - centre) * (b - centre), F.lit(0.0))),
                         F.lit(0.0), lambda a, x: a + x)
    z_serial = serial / (spread * F.sqrt(F.greatest(n - 1, F.lit(1.0))))
    return F.struct(c["encoding"].alias("encoding"), size.alias("size"), n.alias("n"), c["squares"].alias("squares"), chi.alias("chi"),
                    z_chi.alias("z_chi"), bound(half, runs).alias("z_runs"), z_serial.alias("z_serial"))


def fitted_words(tokens: DataFrame) -> dict[str, tuple]:
    """How the corpus' words (rows of ``hit``) fare in the tests, as WORDS_LIKE: words stand for base64 as they are, in
    capitals for base32; numbers stand for hex."""
    letters, digits = F.col("hit").rlike("^[A-Za-z]+$"), F.col("hit").rlike("^[0-9]+$")
    plain = tokens.where(~F.col("hit").rlike("[0-9]") | digits).select("hit")
    forms = plain.select("hit").unionByName(plain.where(letters).select(F.upper("hit").alias("hit")))
    m = forms.select(measured(F.col("hit")).alias("m")).select("m.*")
    # Words of one part only have no runs to count.
    capped = [F.when(F.col(c) != ONE_PART, F.least(F.pow(F.col(c), F.lit(2.0)), F.lit(100.0))) for c in ("z_runs", "z_serial")]
    rows = m.groupBy("encoding").agg(
        F.count("*").alias("words"), F.count(capped[0]).alias("parted"), (F.sum(F.col("squares") - F.col("n")) / F.sum(F.col("n") * (F.col("n") - 1))).alias("coincidence"),
        *[f(c).alias(f"{k}{i}") for i, c in enumerate(capped) for k, f in (("mean", F.avg), ("dev", F.stddev_pop))]).collect()
    found = dict(WORDS_LIKE)
    for r in rows:
        if r["words"] >= LEAST_WORDS and 0 < r["coincidence"] < 1:
            runs = (r["mean0"], max(r["dev0"], 1.0)) if r["parted"] >= LEAST_WORDS else WORDS_LIKE[r["encoding"]][1:3]
            found[r["encoding"]] = tuple(float(v) for v in (r["coincidence"], *runs, r["mean1"], max(r["dev1"], 1.0)))
    return found


def battery(token: Column, words: dict[str, tuple] = WORDS_LIKE) -> Column:
    """Struct of a token's inferred encoding, length, z-scores, length band and p-value (-log10 of it in steps)."""
    return bound(measured(token), lambda m: _judged(token, m, words))


def _judged(token: Column, m: Column, words: dict[str, tuple]) -> Column:
    likes = [F.element_at(F.create_map(*[x for e, v in words.items() for x in (F.lit(e), F.lit(float(v[i])))]), m["encoding"]) for i in range(5)]
    coincidence, (runs, runs_dev), (serial, serial_dev) = likes[0], likes[1:3], likes[3:5]
    n, size = m["n"], m["size"]
    # Characters that agree as often as the words' do, drawn at the token's length.
    mean, dev = size * (1 + (n - 1) * coincidence) - n, size * coincidence * F.sqrt(2 * (1 / coincidence - 1))
    parts = [((m["chi"] - mean) / dev, (mean - (size - 1)) / dev), ((F.pow(m["z_runs"], F.lit(2.0)) - runs) / runs_dev, (runs - 1) / runs_dev),
             ((F.pow(m["z_serial"], F.lit(2.0)) - serial) / serial_dev, (serial - 1) / serial_dev)]
    weights = [F.greatest(w, F.lit(0.0)) for _, w in parts]
    total = F.sqrt(reduce(lambda a, b: a + b, [w * w for w in weights]))
    z = F.when(total > 0, -reduce(lambda a, b: a + b, [w * x for w, (x, _) in zip(weights, parts, strict=True)]) / total).otherwise(F.lit(0.0))
    # Upper normal tail for z > 0, by Abramowitz and Stegun 26.2.17.
    t = 1 / (1 + 0.2316419 * F.greatest(z, F.lit(0.0)))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    minus_log = F.pow(F.greatest(z, F.lit(0.0)), F.lit(2.0)) / 2 / F.log(F.lit(10.0)) + 0.39908993 - F.log10(poly)
    random = (m["z_chi"] < REJECT_Z) & m["z_runs"].between(FEW_RUNS, REJECT_Z) & (F.abs(m["z_serial"]) < REJECT_Z)
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    score = F.when(mixed & random & (z > 0), minus_log).otherwise(F.lit(0.0))
    band = F.lit(0)
    for i, low in enumerate(BANDS):
        band = F.when(n >= low, F.lit(i)).otherwise(band)
    return F.struct(m["encoding"].alias("encoding"), n.cast("int").alias("n"), m["z_chi"].alias("z_chi"), m["z_runs"].alias("z_runs"),
                    m["z_serial"].alias("z_serial"), band.alias("band"), F.least(F.floor(score / P_STEP), F.lit(P_LAST)).cast("int").alias("step"))


def tokens_of(text: Column) -> Column:
    """Spans of all tokens that are long enough."""
    return spans_of(text, "random", TOKEN, 0, 16)


def coded(hit: Column) -> Column:
    """Whether a token holds a digit and a letter, which every random code of this length does but for one in many."""
    return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")


def discovery_steps(tokens: DataFrame) -> dict[int, int]:
    """For each band the smallest p-step that is a discovery (Benjamini and Hochberg over all tokens of the band).

    ``tokens`` holds the battery's struct ``t``, a row for each token. At most len(BANDS) * P_LAST counts are formed.
    """
    counts = tokens.groupBy("t.band", "t.step").count()
    got = {}
    for band, step, n in counts.collect():
        got.setdefault(band, {})[step] = n
    limits = {}
    for band, by_step in got.items():
        total, above = sum(by_step.values()), 0
        for step in sorted(by_step, reverse=True):
            above += by_step[step]
            # A token of this step has a p-value of at most 10 ** (-step * P_STEP).
            if step > 0 and 10 ** (-step * P_STEP) <= FDR * above / total:
                limits[band] = step
    return limits


def clear_of(tokens: Column, base: Column) -> Column:
    """The spans of ``tokens`` that no span of ``base`` overlaps, by the latest end before and the next start behind each."""
    far, is_base = F.lit(2**31 - 1), lambda m: m["no"] < len(BASE)

    def pick(merged: Column) -> Column:
        ended = before(F.transform(merged, lambda m: F.when(is_base(m), m["end"]).otherwise(F.lit(0))), F.greatest)
        ahead = F.reverse(before(F.reverse(F.transform(merged, lambda m: F.when(is_base(m), far - m["start"]).otherwise(F.lit(0)))), F.greatest))
        around = F.zip_with(ended, ahead, lambda a, b: F.struct(a.alias("ended"), (far - b).alias("next")))
        free = F.zip_with(merged, around, lambda m, a: F.when(~is_base(m) & (a["ended"] <= m["start"]) & (a["next"] >= m["end"]), m))
        return F.filter(free, lambda m: m.isNotNull())

    return bound(F.array_sort(F.concat(base, tokens)), pick)


def scan(docs: DataFrame, keep: list[str], text: str = "text", out: str = "spans") -> DataFrame:
    """The kept columns and ``out``: array<struct<start,no,end,kind>> by start and kind, base and found ones.

    A found span that a base span overlaps is left to that. Null and empty texts have no spans; equal rows are
    scanned each; an empty table gives no rows. Positions count code points.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hits = stored(docs.select(F.explode(tokens_of(body)).alias("s")).select("s.hit"))
    words = fitted_words(hits)
    limits = discovery_steps(hits.where(coded(F.col("hit"))).select(battery(F.col("hit"), words).alias("t")))
    base = F.concat(*[spans_of(body, *spec) for spec in BASE])
    if limits:
        rows = docs.select(*[F.col(f"`{c}`") for c in keep], base.alias("__base"), F.filter(tokens_of(body), lambda s: coded(s["hit"])).alias("__tokens"))
        limit_of = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])

        def found(s: Column) -> Column:
            return bound(battery(s["hit"], words), lambda t: t["step"] >= F.coalesce(F.element_at(limit_of, t["band"]), F.lit(P_LAST + 1)))

        extra = F.filter(clear_of(F.col("__tokens"), F.col("__base")), found)
    else:
        rows = docs.select(*[F.col(f"`{c}`") for c in keep], base.alias("__base"))
        extra = F.array().cast("array<struct<start:int,no:int,end:int,hit:string>>")
    kinds = F.array(*[F.lit(k) for k in [*(b[0] for b in BASE), "random"]])
    named = lambda s: F.struct(s["start"], s["no"], s["end"], F.get(kinds, s["no"]).alias("kind"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.transform(F.array_sort(F.concat("__base", extra)), named).alias(out))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


#: Code points of the pieces that a text is cut into, so that no place is sought from the text's beginning.
PIECE = 1024


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans become one mark. ``spans`` are sorted by start."""

    def cut(pieces: Column) -> Column:
        def between(low: Column, high: Column) -> Column:
            first = F.floor(low / PIECE).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, F.floor((high - 1) / PIECE).cast("int") - first + 1), "")
            return F.when(high > low, F.substring(some, low - first * PIECE + 1, high - low)).otherwise(F.lit(""))

        def line(s: Column) -> Column:
            ends = F.transform(s, lambda x: x["end"])
            kept = F.zip_with(s, before(ends, F.greatest), lambda x, at: F.when(
                x["start"] >= at, F.concat(between(at, x["start"]), F.lit(mark))).otherwise(F.lit("")))
            last = F.coalesce(F.array_max(ends), F.lit(0))
            return F.concat(F.array_join(kept, ""), between(last, F.length(text)))

        return bound(spans, line)

    return F.when(text.isNotNull(), bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), cut))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    base = F.filter("spans", lambda s: s["no"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["no"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        count(len(BASE)).alias("n_random"))
