"""URL filters: rules of host and path in sorted arrays of 64-bit xxhash digests, memory-mapped and probed by binary search.

The rules are dealt to files by the top bits of their digests and sorted there, so that any number of them is
written without one task holding all. A URL's candidates are the pairs of a suffix of its host and a
prefix of its path; their digests are looked up in whole batches, and each hit is confirmed by the stored
string, so that colliding digests do no harm.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .caches import held
from .store import cut, map_file, open_fs, work_dir

#: Rules in a file of the array, and URLs whose candidates are probed together.
RULES_EACH, TOGETHER = 1_000_000, 2_048
#: Ends a key's host; no path or host has it. The seed is that of Spark's own xxhash64.
SEPARATOR, SEED = "\x00", 42
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
_JUDGED = "host string, path string, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, and from there up to ``?``, ``#`` or the end.

    Both are empty where the url is null or has no ``://``.
    """
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _writer(folder: str):
    def write(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        digests = table.column("digest").to_numpy().view("u8")
        order = np.argsort(digests, kind="stable")
        table, name = table.take(pa.array(order)), uuid.uuid4().hex  # each attempt writes its own files; the manifest names those that count
        keys = [k.encode() for k in table.column("key").to_pylist()]
        fs, where = open_fs(folder)
        fs.create_dir(where, recursive=True)
        ends = np.cumsum([0, *map(len, keys)])
        for kind, raw in (("key", digests[order].astype("<u8").tobytes()), ("end", ends.astype("<u8").tobytes()), ("txt", b"".join(keys)), ("ver", table.column("blocks").to_numpy(zero_copy_only=False).astype("u1").tobytes())):
            with fs.open_output_stream(f"{where}/{name}.{kind}") as out:
                out.write(raw)
        halves = [k.partition(SEPARATOR) for k in table.column("key").to_pylist()]
        lengths = [pa.array([sorted({len(h[n]) for h in halves})], pa.list_(pa.int32())) for n in (0, 2)]
        return pa.table([table.column("part")[:1], [name], *lengths], names=["part", "name", "hosts", "paths"])

    return write


def write_rules(rules: DataFrame, rules_each: int = RULES_EACH) -> tuple[str, int, list[str | None], list[int], list[int]]:
    """Writes ``rules (host, path, verdict)`` as a digest array: its folder, the bits that choose a file, the files, the lengths of hosts and of paths.

    Hosts are lower-cased (A-Z). A null path is empty and fits all; rules with null or empty host or a
    verdict other than allow and block raise. Of equal rules one is kept: if they differ, that which blocks. Files
    hold about ``rules_each`` rules; each has sorted digests (``key``), 64-bit offsets (``end``) of
    the strings (``txt``) and a byte for each verdict (``ver``). What comes to the driver is a row for each file.
    """
    spark = rules.sparkSession
    ship(spark)
    good = F.coalesce((F.length("host") > 0) & F.col("verdict").isin(ALLOW, BLOCK), F.lit(False))
    host = F.when(good, F.translate("host", _UPPER, _LOWER)).otherwise(F.raise_error(F.lit("a rule needs a host, and allow or block")))
    keyed = rules.select(F.concat(host, F.lit(SEPARATOR), F.coalesce("path", F.lit(""))).alias("key"), F.col("verdict").alias("v"))
    keyed = cut(keyed.groupBy("key").agg(F.max((F.col("v") == BLOCK).cast("int")).alias("blocks")), "rules")
    bits = max(0, -(-keyed.count() // rules_each) - 1).bit_length()
    digest = F.xxhash64("key")
    part = F.shiftrightunsigned(digest, 64 - bits).cast("int") if bits else F.lit(0)
    folder = work_dir(spark, "rules")
    files = keyed.select("key", digest.alias("digest"), "blocks", part.alias("part")).groupBy("part").applyInArrow(_writer(folder), "part int, name string, hosts array<int>, paths array<int>")
    names: list[str | None] = [None] * (1 << bits)
    hosts: set[int] = set()
    paths: set[int] = set()
    for r in cut(files, "rules").collect():  # one row for each file
        names[r.part] = r.name
        hosts.update(r.hosts)
        paths.update(r.paths)
    return folder, bits, names, sorted(hosts), sorted(paths)


class Digests:
    """A digest array as a worker sees it: files are mapped when they are first probed."""

    def __init__(self, folder: str, bits: int, names: list[str | None]):
        self.bits, self.names = np.uint64(bits), names
        (self.fs, self.where), self.open = open_fs(folder), {}

    def _file(self, part: int):
        if part not in self.open:
            raw = {k: map_file(self.fs, f"{self.where}/{self.names[part]}.{k}") for k in ("key", "end", "txt", "ver")}
            self.open[part] = np.frombuffer(raw["key"], "<u8"), np.frombuffer(raw["end"], "<u8"), raw["txt"], np.frombuffer(raw["ver"], "u1")
        return self.open[part]

    def probe(self, digests: np.ndarray, keys: list[str]) -> np.ndarray:
        """For each key 1 where its rule blocks, 0 where it allows, -1 where there is none."""
        out = np.full(len(digests), -1, "int8")
        parts = digests >> (np.uint64(64) - self.bits) if self.bits else np.zeros(len(digests), "u8")
        for part in np.unique(parts).tolist():
            if self.names[part] is None:
                continue
            mine = np.flatnonzero(parts == part)
            sorted_keys, ends, texts, blocks = self._file(part)
            at = np.searchsorted(sorted_keys, digests[mine])
            # a digest that is there may stand for several strings
            open_ = np.flatnonzero((at < len(sorted_keys)) & (sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == digests[mine]))
            for k in open_.tolist():
                want, j = keys[mine[k]].encode(), int(at[k])
                while j < len(sorted_keys) and sorted_keys[j] == digests[mine[k]]:
                    if texts[int(ends[j]) : int(ends[j + 1])] == want:
                        out[mine[k]] = blocks[j]
                        break
                    j += 1
        return out


def _suffixes(host: str, lengths: list[int]) -> list[str]:
    """Of the host and its parent domains those of some lengths; the time is that of the lengths, not of the host."""
    n = len(host)
    return [host[n - k :] for k in lengths if k == n or k < n and host[n - k - 1] == "."]


def _judge(folder: str, bits: int, names: list[str | None], host_lengths: list[int], path_lengths: list[int], default: str):
    def judge(batches):
        from xxhash import xxh64_intdigest

        rules = held("rules", folder, lambda: Digests(folder, bits, names))
        for whole in batches:
            for begin in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(begin, TOGETHER)
                hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
                keys, owner = [], []
                for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                    if host:
                        prefixes = [path[:n] for n in path_lengths if n <= len(path)]
                        mine = [f"{s}{SEPARATOR}{p}" for s in _suffixes(host, host_lengths) for p in prefixes]
                        keys += mine
                        owner += [k] * len(mine)
                distinct = list(dict.fromkeys(keys))
                found = rules.probe(np.fromiter((xxh64_intdigest(key, SEED) for key in distinct), "u8", len(distinct)), distinct)
                hit = {distinct[n]: int(found[n]) for n in np.flatnonzero(found >= 0).tolist()}
                best: list[tuple | None] = [None] * len(hosts)
                for k, key in zip(owner, keys, strict=True):
                    if key in hit:
                        host, _, path = key.partition(SEPARATOR)
                        rank = (len(host) + len(path), len(host), host + path, BLOCK if hit[key] else ALLOW)
                        best[k] = max(best[k] or rank, rank)
                told = [pa.array([b[2] if b else None for b in best], pa.string()), pa.array([b[3] if b else default for b in best], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*batch.schema.names, "rule", "verdict"])

    return judge


def filter_urls(urls: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = (), default: str = ALLOW, rules_each: int = RULES_EACH) -> DataFrame:
    """``(*keep, host, path, rule, verdict)`` of every row of ``urls``.

    A rule fits its host and all subdomains where the path starts with the rule's. Of several the longest in
    characters wins, of equally long ones that with the longer host, and its host and path are ``rule``; where
    none fits, ``rule`` is null and the verdict ``default``. Null urls and urls without ``://`` have empty host and path and fit no
    rule. Repeated urls are judged each; other columns aren't read. An empty table of rules leaves all to ``default``.
    """
    ship(urls.sparkSession)
    array = write_rules(rules, rules_each)
    host, path = host_and_path(F.col(url))
    split = urls.select(*keep, host.alias("host"), path.alias("path"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in urls.select(*keep).schema) if keep else ""
    return split.mapInArrow(_judge(*array, default), kept + _JUDGED)
