"""URL filters as a sort-merge range join.

Hosts are written with their labels reversed and each closed by a dot (``www.example.org`` is ``org.example.www.``),
so that a rule for a host and its subdomains is an interval of keys. Pages and rules are dealt by ranges of that
key; a rule goes to each range its interval meets. In a range, one pass over the sorted keys keeps the stack of
rules whose intervals enclose the current key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, partitions

# Sampled keys per range; only the balance of the ranges depends on them.
KEYS_PER_RANGE = 50


def _after_scheme(url: Column) -> Column:
    scheme = F.substring_index(url, "://", 1)
    return F.when(F.instr(url, "://") > 0, url.substr(F.length(scheme) + 4, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without a scheme or for null."""
    return lower_ascii(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a scheme or for null."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    )


def _range_ends(keys: DataFrame, n_ranges: int) -> list[str]:
    """At most ``n_ranges - 1`` keys that cut the pages into ranges of like size."""
    n = keys.count()
    wanted = KEYS_PER_RANGE * n_ranges
    drawn = keys if n <= wanted else keys.sample(wanted / n, 7)
    found = sorted(r[0] for r in drawn.collect())
    return [found[len(found) * i // n_ranges] for i in range(1, n_ranges)] if found else []


def _deal_pages(ends: list[str]):
    """Add the range of each page; pages with a key that ends several ranges take turns among them."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        cuts = np.array(ends, object)
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), object)
            low = np.searchsorted(cuts, keys, "left")
            high = np.searchsorted(cuts, keys, "right")
            place = low + (at + np.arange(len(keys))) % (high - low + 1)
            at += len(keys)
            yield batch.append_column("range", pa.array(place.astype(np.int32)))

    return deal


def _deal_rules(ends: list[str]):
    """One copy of a rule for each range that its interval of keys meets."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(ends, object)
        for batch in batches:
            keys = batch.column("key").to_pylist()
            # "/" follows "." directly, so it closes the interval of a key that ends in a dot.
            low = np.searchsorted(cuts, np.array(keys, object), "left")
            high = np.array([np.searchsorted(cuts, k[:-1] + "/", "right") if k else len(cuts) for k in keys], int)
            row = np.repeat(np.arange(len(keys)), high - low + 1)
            place = np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)]) if len(keys) else low
            yield batch.take(pa.array(row)).append_column("range", pa.array(place.astype(np.int32)))

    return deal


class _Host:
    """The rules of one host: verdicts by path, looked up by the lengths that occur."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.paths: dict[str, str] = {}
        self.lengths: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        if self.paths.get(path) != "block":
            self.paths[path] = verdict
        self.lengths = sorted({len(p) for p in self.paths}, reverse=True)

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if n <= len(path) and path[:n] in self.paths), None)


def _sweep(default: str):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Host] = []
        current = None
        for batch in batches:
            rows = batch.to_pydict()
            out = {"id": [], "host": [], "path": [], "rule": [], "verdict": []}
            for i, (place, key, is_page) in enumerate(zip(rows["range"], rows["key"], rows["is_page"])):
                if place != current:
                    stack, current = [], place
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                host, path = rows["host"][i], rows["path"][i]
                if not is_page:
                    if not stack or stack[-1].key != key:
                        stack.append(_Host(key, host))
                    stack[-1].add(path, rows["verdict"][i])
                    continue
                best = None
                for entry in stack:  # from the shortest host to the longest
                    found = entry.longest(path)
                    if found is not None and (best is None or len(entry.host) + len(found) >= len(best[0])):
                        best = (entry.host + found, entry.paths[found])
                out["id"].append(rows["id"][i])
                out["host"].append(host)
                out["path"].append(path)
                out["rule"].append(best and best[0])
                out["verdict"].append(best[1] if best else default)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["id"], batch.schema.field("id").type)]
                + [pa.array(out[c], pa.string()) for c in ("host", "path", "rule", "verdict")],
                names=list(out),
            )

    return sweep


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow"
) -> DataFrame:
    """(id, host, path, rule, verdict): the longest rule that fits each url, else ``default``.

    ``rules`` has (host, path, verdict). A rule fits its host and all subdomains where the url's path starts with
    its own; the longest host plus path wins, and of like lengths the longer host. Of a rule given twice,
    ``block`` wins; rules with a null host, path or verdict are none. A null url or one without ``://`` has an
    empty host and path, which only a rule with empty host and path fits. Rows with equal or null ids are judged
    one by one; other columns are left out. Empty tables give empty results, no rules the default everywhere.
    """
    parsed = pages.select(
        F.col(id_column).alias("id"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path")
    ).withColumn("key", host_key(F.col("host")))
    ends = _range_ends(parsed.select("key"), partitions(pages))
    id_type = parsed.schema["id"].dataType.simpleString()

    at_pages = parsed.mapInArrow(
        _deal_pages(ends), f"id {id_type}, host string, path string, key string, range int"
    ).select("id", "host", "path", F.lit(None).cast("string").alias("verdict"), "key", "range", F.lit(True).alias("is_page"))
    at_rules = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .dropna()
        .withColumn("key", host_key(F.col("host")))
        .mapInArrow(_deal_rules(ends), "host string, path string, verdict string, key string, range int")
        .select(F.lit(None).cast(id_type).alias("id"), "host", "path", "verdict", "key", "range", F.lit(False).alias("is_page"))
    )
    judged = (
        at_pages.unionAll(at_rules)
        .repartitionByRange(len(ends) + 1, "range")
        .sortWithinPartitions("range", "key", "is_page")
        .mapInArrow(_sweep(default), f"id {id_type}, host string, path string, rule string, verdict string")
    )
    return judged.withColumnRenamed("id", id_column)
