"""URL filters by a trie over reversed host labels and path segments, with the longest match deciding.

A rule is a host, a path prefix and a verdict. The trie descends the host's labels from the last one (so a rule fits its host and
all subdomains), and at each rule's host a second trie descends the path's segments; a rule's last segment need only
begin the url's. The deepest host wins, then the longest path. The trie is broadcast in blocks of at most `BLOCK` rules; more
rules take more blocks, one after the other over the same rows, with no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rules broadcast at a time.
BLOCK = 100_000


@dataclass(frozen=True)
class UrlRule:
    rule: str
    """host, a slash and the rest of the path prefix."""
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]

    @property
    def rank(self) -> tuple[int, int]:
        """Of rules that fit one url, the one of highest rank decides."""
        return self.host.count("."), len(self.path)


class _Node:
    __slots__ = ("next", "ends")

    def __init__(self):
        self.next: dict[str, _Node] = {}
        self.ends: list = []


class UrlTrie:
    def __init__(self, rules: list[UrlRule]):
        self.root = _Node()
        for r in rules:
            node = self.root
            for label in reversed(r.host.split(".")):
                node = node.next.setdefault(label, _Node())
            if not node.ends:
                node.ends.append(_Node())
            node = node.ends[0]
            *whole, last = r.path.split("/")[1:]
            for segment in whole:
                node = node.next.setdefault(segment, _Node())
            node.ends.append((last, r))

    @staticmethod
    def _path(node: _Node, segments: list[str]) -> UrlRule | None:
        best = None
        for i, segment in enumerate(segments):
            fit = [x for x in node.ends if segment.startswith(x[0])]
            if fit:
                best = max(fit, key=lambda x: len(x[0]))[1]
            node = node.next.get(segment) if i < len(segments) - 1 else None
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> UrlRule | None:
        if path[:1] != "/":
            return None
        segments = path.split("/")[1:]
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.next.get(label)
            if node is None:
                break
            if node.ends:
                best = self._path(node.ends[0], segments) or best
        return best


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_verdicts(pages: DataFrame, rules: list[UrlRule], otherwise: str = "allow", block: int = BLOCK) -> DataFrame:
    """One row for each row of `pages` (page_id, url): page_id, host, path, rule, verdict.

    A null or empty url, or one without ://, has an empty host and path, fits no rule and gets `otherwise`. Whole urls are read,
    however long. Repeated rules count once; of equal rules with two verdicts, block stands. Repeated rows are judged each; other
    columns are ignored; an empty table gives an empty table.
    """
    ordered = sorted({(r.rule, r.verdict) for r in rules}, key=lambda x: (x[0], x[1] != "allow"))
    kept = [UrlRule(rule, verdict) for rule, verdict in dict(ordered).items()]
    df = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    schema, spark, scratch, written = df.schema, pages.sparkSession, None, None
    for i in range(0, len(kept), block):
        trie = spark.sparkContext.broadcast(UrlTrie(kept[i : i + block]))
        df = df.mapInArrow(_judged(trie), schema)
        if i + block < len(kept):  # written, so that an executor holds one trie at a time
            scratch = scratch or Scratch(spark)
            df = scratch.write(df)
            trie.destroy()
            if written is not None:
                scratch.drop(written)
            written = df
    return df


def _judged(trie):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rule, verdict = b.column(3).to_pylist(), b.column(4).to_pylist()
            for i, (host, path) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                found = trie.value.match(host, path)
                if found and (rule[i] is None or found.rank > UrlRule(rule[i], "").rank):
                    rule[i], verdict[i] = found.rule, found.verdict
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], b.schema.names)

    return run
