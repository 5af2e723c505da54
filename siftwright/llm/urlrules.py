"""URL rules by a sort-merge range join: reversed hosts are sorted, and a sweep keeps a stack of the nested rules around it.

The key of a host is its labels in reverse, each with a dot after it (`www.example.com` is `com.example.www.`): the keys
of a host and of all its subdomains are an interval of the sorted keys, and two intervals are nested or apart.

1. URLs and rules are sorted together by (key, path, id) into ranges, which splits a host that very many URLs share.
   So a rule lies in the range in which its interval begins.
2. A rule goes besides to every range whose first key lies in its interval: those are found by the prefixes of the
   first keys, as many rows as ranges times labels of a host.
3. Within a range, rules and URLs meet in order of key. Rules of a host that ends before the next key leave the stack;
   the others are the rules around the URL, and the longest whose path begins the URL's path decides.

The longest rule is the one with most characters of host and path together, then of the host. Rules are matched as they
are written, but for A-Z in hosts, which are lower-cased; rules with null host or path never fit, and of rules given
twice with different verdicts `block` holds.

Defined cases: host and path as in `url_host` and `url_path`; null URLs and URLs without `://` have neither and fit no
rule; no rule at all or no fitting one gives a null rule and the `default` verdict, since a filter keeps what it has no
reason to block; repeated rows are judged each; ids may be null and of any type that can be sorted; columns of other
names are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import stage_table, type_of

#: The rules of the registered query: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"\A([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels of a host in reverse, each with a dot after it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Nest:
    """The rules around a key: a stack of hosts, each inside the one below it, with their paths."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, dict[str, str], list[int]]] = []

    def leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def enter(self, key: str, host: str, path: str, verdict: str) -> None:
        self.leave(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, {}, []))
        paths, sizes = self.stack[-1][2:]
        paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def judge(self, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits the path."""
        best, most = None, (-1, -1)
        for _, host, paths, sizes in self.stack:
            for n in sizes:
                if n <= len(path) and (verdict := paths.get(path[:n])) is not None:
                    if (len(host) + n, len(host)) > most:
                        best, most = (host + path[:n], verdict), (len(host) + n, len(host))
                    break
        return best


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, key, path, id, host, verdict; the verdict is null for URLs) in order -> (id, host, path, rule, verdict)."""
    nest, at, last, found = Nest(), None, None, None
    for batch in batches:
        kept, out = [], []
        ranges, keys, paths, _, hosts, verdicts = (c if i == 3 else c.to_pylist() for i, c in enumerate(batch.columns))
        for i, (n, key, path, host, verdict) in enumerate(zip(ranges, keys, paths, hosts, verdicts, strict=True)):
            if n != at:
                nest, at, last = Nest(), n, None
            if verdict is not None:
                nest.enter(key, host, path, verdict)
                last = None
                continue
            if last != (key, path):
                nest.leave(key)
                found, last = nest.judge(path), (key, path)
            kept.append(i)
            out.append(found or (None, None))
        rows = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(3), rows.column(4), rows.column(2), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=["id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of pages; rules are (host, path, verdict)."""
    url = F.col(f"`{url_col}`")
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), url_host(url).alias("host"), url_path(url).alias("path"), F.lit(None).cast("string").alias("verdict"))
    wanted = rules.select(F.lit(None).cast(urls.schema["id"].dataType).alias("id"), ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna(subset=["host", "path", "verdict"]).distinct()
    both = urls.unionByName(wanted).withColumn("key", host_key(F.col("host")))
    order = ["key", F.col("verdict").isNull(), "path"]
    rows = stage_table(both.repartitionByRange(*order, "id").withColumn("range", F.spark_partition_id()), "url-ranges")
    # one row for each range, as many as partitions
    ranges = stage_table(rows.groupBy("range").agg(F.min("key").alias("first")), "url-bounds")
    labels = F.split(F.col("first"), r"\.")
    around = ranges.select("range", F.explode(F.sequence(F.lit(1), F.size(labels) - 1)).alias("n"), "first").select("range", F.expr("concat(substring_index(first, '.', n), '.')").alias("key")).distinct()
    carried = wanted.withColumn("key", host_key(F.col("host"))).join(around, "key")
    columns = ["range", "key", "path", "id", "host", "verdict"]
    swept = rows.select(columns).unionByName(carried.select(columns)).repartition("range").sortWithinPartitions("range", *order).mapInArrow(_sweep, f"{type_of(urls, 'id')}, host string, path string, rule string, verdict string")
    return swept.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


ORACLE = f"""
WITH urls AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}) AS t(rule_host, rule_path, rule_verdict)),
fits AS (
  SELECT u.host, u.path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) u JOIN rules ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM parts LEFT JOIN fits USING (host, path)
"""
