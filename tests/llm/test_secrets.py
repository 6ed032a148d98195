import base64
import hashlib
import random
import re

from helixmart.llm import secrets as S

SCHEMA = "doc_id long, text string, spans string"
BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def brute(text):
    spans = []
    for no, (kind, pattern, group, least) in enumerate(BASE):
        spans += [(m.start(), no, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [s for _, _, s in sorted(spans)]


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    rows = S.scan(docs, ["doc_id"]).select("doc_id", S.joined(S.F.col("spans")).alias("s"), "spans").collect()
    assert len(rows) == len(texts)
    return {r.doc_id: r.s.split(",") if r.s else [] for r in rows}


def test_base_spans_against_re(spark):
    hexes = "deadbeef" * 4
    texts = [None, "", "password: token = abcdefgh", "token=token=abcdefgh", "é😀 PassWord='hunter22' x", "api_key : \"sk.12-34/5=\" apikey=12345",
             "AKIA" + "Z" * 15, "AKIA" + "A1" * 8 + "x", "AKIAAKIA" + "B" * 12, hexes, hexes[:23], f"token={hexes} {hexes}g", "secret==abcdef",
             "passwd\n=abcdefgh", f"AKIA{'0' * 16}{hexes}", "a" * 30_000 + " token=zzzzzz", "ſecret=abcdefgh toKen=abcdefgh"]
    rng = random.Random(4)
    parts = ["token", "=", ":", " ", '"', "'", "AKIA", "abc", "ABC123DEF456GHI7", "0123456789abcdef0123", "secret", "é", "😀", "\n", "api_key", "x-y"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    for i, spans in scanned(spark, texts).items():
        assert [s for s in spans if not s.startswith("random")] == brute(texts[i]), texts[i]


def test_battery_finds_random_codes_and_leaves_words(spark):
    rng = random.Random(5)
    code = lambda n: base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=")
    plain = ["entekeitschpfkeitberlichlich", "some_long_identifier_name_2024", "2024-01-01-report-final-version2", "aaaaaaaaaaaaaaaaaaaaaaaa11111111",
             "https://example.com/en/articles/2021/archive", "abababababababababab1212121212121212", "0000000000000000000000001"] * 20
    codes = [code(30) for _ in range(60)]
    got = scanned(spark, [f"see {x} there" for x in plain + codes])
    hit = [any(s.startswith("random") for s in got[i]) for i in range(len(got))]
    assert not any(hit[: len(plain)])
    assert sum(hit[len(plain):]) >= 55
    for i in range(len(plain), len(got)):
        assert got[i] in ([], [f"random:4:{4 + len(codes[i - len(plain)])}"])


def test_redaction(spark):
    text = "é password=hunter22 and " + "ab12" * 10 + " end"
    docs = spark.createDataFrame([(1, text, "x"), (2, "clean", "x"), (3, None, "x")], SCHEMA)
    found = S.scan(docs.drop("spans"), ["doc_id", "text"])
    got = {r.doc_id: r.t for r in found.select("doc_id", S.redacted(S.F.col("text"), S.F.col("spans")).alias("t")).collect()}
    assert got == {1: "é [SECRET] and [SECRET] end", 2: "clean", 3: None}


def test_op9_over_the_table(spark, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    query = S.op9_secrets(spark, tiny)
    plan = query._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    for r in query.collect():
        base = brute(texts.pop(r.doc_id))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == base
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
    assert not texts


def test_empty_table(spark):
    assert S.scan(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0


def test_many_matches_take_linear_time(spark):
    """A text of nothing but codes: spans, and the redacted text, as by hand."""
    import time

    from pyspark.sql import functions as F

    r = random.Random(3)
    codes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(16_000)]
    text = "é ".join(codes)
    df = spark.createDataFrame([(1, text), (2, "é" * 3000), (3, ""), (4, "x " * 700 + codes[0])], "doc_id long, text string")
    begun = time.time()
    rows = {r.doc_id: r for r in S.scan(df, ["doc_id", "text"]).withColumn("cut", S.redacted(F.col("text"), F.col("spans"))).collect()}
    assert time.time() - begun < 60
    assert [(s.start, s.end) for s in rows[1].spans if s.kind == "hex"] == [(42 * i, 42 * i + 40) for i in range(len(codes))]
    assert rows[1].cut == "é ".join(["[SECRET]"] * len(codes))
    assert rows[2].cut == "é" * 3000 and rows[3].cut == "" and rows[4].cut == "x " * 700 + "[SECRET]"


def test_overlapping_spans_become_one_mark(spark):
    from pyspark.sql import functions as F

    text = "".join(chr(97 + i % 26) for i in range(5000))
    r = random.Random(1)
    spans = sorted((a, a + r.randrange(1, 40)) for a in r.sample(range(4900), 700))
    df = spark.createDataFrame([(text, [(a, b) for a, b in spans]), (text, [])], "text string, spans array<struct<start:int,end:int>>")
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out.append(text[at:a] + "#")
        at = max(at, b)
    got = [r[0] for r in df.select(S.redacted(F.col("text"), F.col("spans"), "#")).collect()]
    assert got == ["".join(out) + text[at:], text]


def test_spans_clear_of_others(spark):
    from pyspark.sql import functions as F

    r = random.Random(7)
    rows = []
    for i in range(60):
        base = [(a, r.randrange(3), a + r.randrange(1, 30), "b") for a in r.sample(range(2000), r.choice([0, 1, 5, 40]))]
        tokens = [(a, 3, a + r.randrange(1, 20), "t") for a in r.sample(range(2000), r.choice([0, 3, 300]))]
        rows.append((i, tokens, base))
    kind = "array<struct<start:int,no:int,end:int,hit:string>>"
    df = spark.createDataFrame(rows, f"i int, t {kind}, b {kind}")
    got = {r.i: [tuple(x) for x in r.c] for r in df.select("i", S.clear_of(F.col("t"), F.col("b")).alias("c")).collect()}
    for i, tokens, base in rows:
        assert got[i] == sorted(t for t in tokens if not any(b[0] < t[2] and t[0] < b[2] for b in base))


def test_recall_of_random_codes(spark):
    """Codes are one in ten of a corpus' code-like tokens; the rest are words, numbers and identifiers."""
    from pyspark.sql import functions as F

    r = random.Random(11)
    syllables = ["ton", "er", "ing", "li", "che", "the", "an", "keit", "ment", "ver", "sch", "ra", "po", "in"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(5, 9))).ljust(16, "e")
    plain = [word() for _ in range(2500)] + [str(r.randrange(10**15, 10**18)) for _ in range(300)]
    plain += [f"{word()}_{r.randrange(10000)}" for _ in range(1500)] + [f"{word().title()}{r.randrange(2030)}{word()}" for _ in range(1500)]
    kinds = {"base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32), "HEX": ("0123456789ABCDEF", 20),
             "alnum": ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 24),
             "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 40)}
    codes = [(k, "".join(r.choice(a) for _ in range(n))) for k, (a, n) in kinds.items() for _ in range(80)]
    rows = [(i, f"see {t} here", "plain") for i, t in enumerate(plain)] + [(10_000 + i, f"see {t} here", k) for i, (k, t) in enumerate(codes)]
    found = S.scan(spark.createDataFrame(rows, "doc_id long, text string, sort string"), ["sort"]).groupBy("sort").agg(
        F.avg(F.exists("spans", lambda s: s["kind"] == "random").cast("int")).alias("share")).collect()
    share = {x.sort: x.share for x in found}
    assert share.pop("plain") < 0.005
    assert all(v >= 0.9 for v in share.values()), share
