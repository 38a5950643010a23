"""URL filters as a sort-merge range join.

A host's labels, last first and each followed by a slash, make a key in which
a domain and all its subdomains are one interval: the keys that begin with the
domain's. URLs and rules are sorted together by key (a URL's key goes on with
its path, so a host with a third of all rows is many keys) and dealt out by
ranges. One sweep over a range keeps a stack of the rules whose intervals are
open; the intervals are nested, so a rule that has ended is always on top. The
rules that are open where a range begins are those of the first row's domains.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import ascii_lower, boxed, cut

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
ALLOW, BLOCK = "allow", "block"


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def host_key(name: Column) -> Column:
    """com/example/www/ for www.example.com."""
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.", -1)), "/"), F.lit("/"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, rules before URLs where keys are equal: each URL's
    host key and path with the rule that decides it."""
    stack: list[tuple[str, dict[str, str], set[int]]] = []  # host key, verdict by path, lengths of paths
    names = ["_key", "_hkey", "_path", "_verdict", "_asks"]
    for b in batches:
        out = []
        for key, hkey, p, verdict, asks in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not asks:
                if not stack or stack[-1][0] != hkey:
                    stack.append((hkey, {}, set()))
                stack[-1][1].setdefault(p, verdict)
                stack[-1][2].add(len(p))
                continue
            best = (-1, "", "", None)
            for h, by_path, sizes in stack:
                if hkey.startswith(h):
                    fit = max((n for n in sizes if n <= len(p) and p[:n] in by_path), default=-1)
                    if fit >= 0 and len(h) + fit >= best[0]:
                        best = (len(h) + fit, h, p[:fit], by_path[p[:fit]])
            rule = ".".join(reversed(best[1][:-1].split("/"))) + best[2] if best[3] else None
            out.append((hkey, p, rule, best[3]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["_hkey", "_path", "rule", "verdict"])


def judged(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """urls with host, path, rule and verdict (columns of those names are replaced).

    rules: host, path, verdict (allow or block). A rule fits its host and all
    subdomains, if the URL's path begins with the rule's. The longest rule wins,
    of equally long ones that with the longer host; without any, the verdict is
    `default` and rule is null. Of rules with equal host and path, block wins.
    Rules with a null part are ignored. A null URL, or one without "://", has an
    empty host and path. Rows may repeat; other columns, of any names, stay as they are.
    """
    rows = boxed(urls, host(F.col(url_col)).alias("_host"), path(F.col(url_col)).alias("_path"))
    rows = rows.withColumn("_hkey", host_key(F.col("_host")))
    held = rules.where("host is not null and path is not null and verdict is not null")
    held = held.groupBy(host_key(ascii_lower(F.col("host"))).alias("_hkey"), F.col("path").alias("_path")).agg(F.max("verdict").alias("_verdict"))
    held = cut(held.withColumns({"_key": F.col("_hkey"), "_asks": F.lit(False)}))
    # equal hosts and paths are judged once
    asked = rows.select("_hkey", "_path").distinct().withColumns({"_verdict": F.lit(None).cast("string"), "_key": F.concat("_hkey", "_path"), "_asks": F.lit(True)})
    ranged = cut(held.select(asked.columns).union(asked).repartitionByRange("_key", "_asks").withColumn("_part", F.spark_partition_id()))
    # rules of the first row's domains, repeated at the head of its range
    labels = F.split("_first", "/")
    ups = ranged.groupBy("_part").agg(F.min("_key").alias("_first"))
    ups = ups.select("_part", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "/"), F.lit("/")))).alias("_hkey"))
    every = ranged.unionByName(ups.join(held, "_hkey").select(ranged.columns))
    every = every.repartition("_part").sortWithinPartitions("_part", "_key", "_asks", "_path")
    decided = every.drop("_part").mapInArrow(_sweep, "_hkey string, _path string, rule string, verdict string")
    found = rows.join(decided, ["_hkey", "_path"], "left")
    own = [F.col(f"row.`{c}`") for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return found.select(*own, F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
