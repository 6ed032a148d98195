"""URL rules and block lists in a sorted digest array.

The list's keys become shards of a digest array: sorted 64-bit xxhash keys, and the full strings behind them. A
task maps the keys of its shard into memory, probes them with a vectorised binary search and confirms every hit
against the stored string, so a digest collision never judges a URL. URLs are cut to their possible keys (host
suffix + path prefix) without Python, and equal keys are probed once, so a host with a third of all rows costs
what any other host costs.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixmart.llm.common import stored, table

#: verdict, host, path: the rules of the registered query. The longest that fits wins.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Hosts that the registered query blocks where no rule fits.
BLOCKED_HOSTS = ["spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org", "cheap-pills.example.com",
                 "cheap-pills.example.net", "cheap-pills.example.org"]
#: Listed strings per shard of the array.
SHARD_ENTRIES = 500_000
ENTRIES = "kind string, verdict string, key string"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def entries(spark: SparkSession, rules: list[tuple[str, str, str]], hosts: list[str]) -> DataFrame:
    """(kind, verdict, key): rules carry host and path, listed hosts the host alone."""
    rows = [("rule", v, h + p) for v, h, p in rules] + [("host", "block", h) for h in hosts]
    return spark.createDataFrame(rows, ENTRIES)


def digest_array(listed: DataFrame) -> DataFrame:
    """Shards of the sorted digest array: (shard, keys, offsets, strings, payload), one row each."""
    shards = max(1, -(-listed.count() // SHARD_ENTRIES))
    schema = "shard int, keys binary, offsets binary, strings binary, verdicts array<string>"

    def build(key, t):
        digest = t["digest"].to_numpy().view(np.uint64)
        order = np.argsort(digest, kind="stable")
        texts = [t["kind"][i].as_py()[0].encode() + t["key"][i].as_py().encode() for i in order.tolist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "keys": [digest[order].tobytes()],
                         "offsets": [offsets.tobytes()], "strings": [b"".join(texts)],
                         "verdicts": [[t["verdict"][i].as_py() for i in order.tolist()]]})

    keyed = listed.dropDuplicates(["kind", "key"]).withColumn("digest", F.xxhash64("kind", "key"))
    keyed = keyed.withColumn("shard", F.pmod("digest", F.lit(shards)).cast("int"))
    return stored(keyed.groupBy("shard").applyInArrow(build, schema))


def probe(wanted: DataFrame, array: DataFrame, salts: int) -> DataFrame:
    """The (kind, key) of ``wanted`` that are listed, with their verdict. ``wanted`` holds each pair once; it is
    dealt over the array's shards times ``salts``, so a task's share is bounded."""
    shards = max(1, array.count())
    keyed = wanted.withColumn("digest", F.xxhash64("kind", "key"))
    keyed = keyed.withColumn("shard", F.pmod("digest", F.lit(shards)).cast("int"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(salts)).cast("int"))
    spread = array.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def search(left, right):
        out = {"kind": [], "key": [], "verdict": []}
        if right.num_rows and left.num_rows:
            # A view of the shard's bytes where they lie, as of a mapped file: nothing is copied or parsed.
            keys = np.frombuffer(right["keys"].combine_chunks()[0].as_buffer(), np.uint64)
            offsets = np.frombuffer(right["offsets"].combine_chunks()[0].as_buffer(), np.int64)
            strings, verdicts = memoryview(right["strings"].combine_chunks()[0].as_buffer()), right["verdicts"][0].as_py()
            digest = left["digest"].to_numpy().view(np.uint64)
            low, high = np.searchsorted(keys, digest), np.searchsorted(keys, digest, side="right")
            for i in np.flatnonzero(low < high).tolist():
                kind, key = left["kind"][i].as_py(), left["key"][i].as_py()
                text = kind[0].encode() + key.encode()
                for j in range(low[i], high[i]):
                    if strings[offsets[j] : offsets[j + 1]] == text:
                        out["kind"].append(kind)
                        out["key"].append(key)
                        out["verdict"].append(verdicts[j])
        return pa.table({k: pa.array(v, pa.string()) for k, v in out.items()})

    return keyed.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(
        search, "kind string, key string, verdict string")


def judge_urls(pages: DataFrame, listed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per row of ``pages`` (url): the kept columns, host, path, rule, verdict, listed.

    A rule fits its host and all subdomains when the path starts with the rule's path; the longest rule wins.
    Without a fitting rule, a listed host or parent host blocks; everything else is allowed. A null URL or one
    without ``://`` has an empty host and path, fits nothing and is allowed. Equal URLs are judged once and
    repeated rows kept. ``listed`` comes from ``entries``.
    """
    listed = stored(listed)
    # Lengths of listed paths: at most as many as a URL has characters.
    lengths = sorted(r[0] for r in listed.where("kind = 'rule'").select(
        F.length(F.regexp_extract("key", r"^[^/]*(.*)$", 1))).distinct().collect())
    urls = pages.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = stored(urls)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    starts = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths] or [F.lit("")]))
    starts = F.filter(starts, lambda p: F.length(p).isin(lengths or [-1]))
    hosts = F.transform(suffixes, lambda h: F.struct(F.lit("host").alias("kind"), h.alias("key")))
    rules = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.struct(
        F.lit("rule").alias("kind"), F.concat(h, p).alias("key")))))
    wanted = urls.where("host != ''").select("url", F.explode(F.concat(hosts, rules)).alias("w")).select("url", "w.*")
    # About half a million probes in a task, however many URLs there are.
    salts = max(1, urls.count() * 4 // SHARD_ENTRIES)
    hits = probe(wanted.select("kind", "key").distinct(), digest_array(listed), salts)
    found = wanted.join(stored(hits), ["kind", "key"])
    best = found.groupBy("url").agg(
        F.max(F.when(F.col("kind") == "rule", F.struct(F.length("key").alias("n"), "key", "verdict"))).alias("rule"),
        F.max(F.col("kind") == "host").alias("listed"))
    judged = urls.join(best, "url", "left").select(
        "url", "host", "path", F.col("rule.key").alias("rule"), F.coalesce("listed", F.lit(False)).alias("listed"),
        F.coalesce("rule.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col("url").alias("_url"))
    return rows.join(judged, F.col("_url").eqNullSafe(F.col("url"))).select(
        *[F.col(f"`{c}`") for c in keep], "host", "path", "rule", "verdict", "listed")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, entries(spark, RULES, BLOCKED_HOSTS), ["page_id"])


def url_filter_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    hosts = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
    return rf"""
WITH r(v, h, p) AS (VALUES {rules}), l(h) AS (VALUES {hosts}),
u AS (SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
j AS (SELECT u.*, (SELECT max({{'n': length(h || p), 'key': h || p, 'v': v}}) FROM r
                   WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best,
             EXISTS (SELECT 1 FROM l WHERE host = h OR ends_with(host, '.' || h)) AS listed FROM u)
SELECT page_id, host, path, best.key AS rule,
       coalesce(best.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j"""
