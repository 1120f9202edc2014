"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of `width` consecutive words (an item of fewer words is one window). A window's set holds its
shingles of three words (fewer, if it has fewer). All of them must be in a document for the window to occur there, so one
prefix token is enough: the window's rarest shingle, by occurrences counted over all documents. Documents are joined with
windows on prefix tokens alone; a candidate then has its place fixed by the token's offset in the window, must fit before the
text's end (length) and start at or after its first word (position), and is verified word by word.

The item side is sent to every task in blocks of at most `BLOCK` windows, a proven bound. More items take more blocks: the rows are
written between two of them and the block's index is destroyed, so that an executor holds one block at a time. Documents are never
shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, Scratch, Words, lean_batches, let_go, word_chunks

SHINGLE = 3
#: Windows broadcast at a time; each holds some hundred bytes in a worker.
BLOCK = 200_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER))


def _hashes(words: list[str], k: int) -> np.ndarray:
    data = " ".join(words).encode("utf-8", "surrogatepass")
    w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM_WORDS)
    h, ok = w.shingles(k)
    return h[ok]


class Block:
    """Windows by prefix token: per shingle width, a sorted array of tokens with the windows of each."""

    def __init__(self, items: list[tuple[object, list[str]]], width: int, seen: dict[int, int]):
        windows: dict[tuple[str, ...], set] = defaultdict(set)
        for item, words in items:
            for i in range(max(1, len(words) - width + 1)) if words else ():
                windows[tuple(words[i : i + width])].add(item)
        self.text, self.items, self.n_words, self.offset = [], [], [], []
        by: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for words, who in windows.items():
            k = min(SHINGLE, len(words))
            tokens = _hashes(list(words), k).tolist()
            at = min(range(len(tokens)), key=lambda i: (seen.get(tokens[i], 0), tokens[i]))
            by[k][tokens[at]].append(len(self.text))
            self.text.append(" ".join(words).encode("utf-8", "surrogatepass"))
            self.items.append([None if x is None else str(x) for x in sorted(who, key=str)])
            self.n_words.append(len(words))
            self.offset.append(at)
        self.tokens = {k: np.array(sorted(x), np.uint64) for k, x in by.items()}
        self.windows = {k: [x[t] for t in sorted(x)] for k, x in by.items()}

    def find(self, w: Words):
        """(document in the chunk, first word, end word, window) of every occurrence."""
        place = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        for k, tokens in self.tokens.items():
            h, ok = w.shingles(k)
            at = np.searchsorted(tokens, h)
            at[at == len(tokens)] = 0
            for i in np.flatnonzero((tokens[at] == h) & ok).tolist():
                doc = int(place[i])
                low, high = int(w.first[doc]), int(w.first[doc + 1])
                for x in self.windows[k][at[i]]:
                    a = i - self.offset[x]
                    b = a + self.n_words[x]
                    if a >= low and b <= high and w.text(a, b) == self.text[x]:
                        yield doc, a - low, b - low, x


def occurrences(docs: DataFrame, items: list[list[str]]) -> dict[int, int]:
    """How often each shingle of the items occurs in all documents. Only the items' own shingles are counted and returned."""
    sc = docs.sparkSession.sparkContext
    tokens: dict[int, set[int]] = defaultdict(set)
    for words in items:
        for k in range(1, SHINGLE + 1):
            if len(words) >= k:
                tokens[k].update(_hashes(words, k).tolist())
    sorted_tokens = sc.broadcast({k: np.array(sorted(x), np.uint64) for k, x in tokens.items() if k == SHINGLE or any(len(w) == k for w in items)})

    def run(batches):
        import pyarrow as pa

        total = {k: np.zeros(len(x), np.int64) for k, x in sorted_tokens.value.items()}
        for b in batches:
            for _, _, w in word_chunks(b.column(0), ALNUM_WORDS):
                for k, x in sorted_tokens.value.items():
                    h, ok = w.shingles(k)
                    at = np.searchsorted(x, h)
                    at[at == len(x)] = 0
                    total[k] += np.bincount(at[(x[at] == h) & ok], minlength=len(x))
        for k, x in sorted_tokens.value.items():
            found = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(x[found].view(np.int64)), pa.array(total[k][found])], ["token", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = {t % (1 << 64): n for batch in counted.toArrow().to_batches() for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
    sorted_tokens.destroy()
    return found


def _blocks(items: DataFrame, width: int, most: int):
    """Items in blocks of at most `most` windows, in order of id; a longer item goes into several. The driver holds one block of
    item texts at a time."""
    held, size = [], 0
    rows = items.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy(F.col("item_id").cast("string"))
    for row in rows.toLocalIterator():
        words = item_words(row.text)
        # a long item is split where windows begin, so that each part is within the bound and no window is lost
        for at in range(0, max(1, len(words) - width + 1) if words else 0, most):
            part = words[at : at + most + width - 1]
            n = max(1, len(part) - width + 1)
            if held and size + n > most:
                yield held
                held, size = [], 0
            held.append((row.item_id, part))
            size += n
    if held:
        yield held


def contaminated_words(docs: DataFrame, items: DataFrame, width: int = 10, block: int = BLOCK, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of `docs` (text and the columns to carry): those, text, n_words, hits (array of [first word, end word) runs of hit words),
    item_ids (array of string, sorted), n_items, n_hit.

    n_items is the number of items with occurring windows. items: item_id, text. A null or empty text on either side has no words; items
    without words fit nothing; repeated items count once under their id; those without an id hit words like any other, count as one item
    together, and are not in item_ids. An empty item table hits nothing. Texts are searched whole, however long; rows that repeat are
    searched each; an empty table gives an empty one. Other columns are ignored.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    kept = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    df = docs.select(*kept, F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<long>)").alias("runs"), F.expr("cast(array() as array<string>)").alias("item_ids"))
    schema = df.schema
    blocks = _blocks(items, width, block)
    held, scratch, written = next(blocks, []), Scratch(spark), None  # without items one empty block still counts words
    while True:
        index = spark.sparkContext.broadcast(Block(held, width, occurrences(docs, [w for _, w in held]) if held else {}))
        df = df.mapInArrow(_search(index), schema)
        held = next(blocks, None)
        if held is None:
            break
        df = scratch.write(df)
        index.destroy()
        if written is not None:
            scratch.drop(written)
        written = df
    pairs = F.expr("transform(sequence(1, cast(size(runs) / 2 as int), 1), i -> struct(runs[2 * i - 2] as first, runs[2 * i - 1] as end))")
    hits = F.when(F.size("runs") > 0, pairs).otherwise(F.expr("cast(array() as array<struct<first: long, end: long>>)"))
    df = df.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)), "text", "n_words", hits.alias("hits"), F.array_sort(F.array_compact("item_ids")).alias("item_ids"), F.size("item_ids").cast("long").alias("n_items"))
    return df.withColumn("n_hit", F.expr("aggregate(hits, cast(0 as long), (n, x) -> n + x.end - x.first)"))


def _search(held):
    def run(batches):
        import pyarrow as pa

        block = held.value
        let_go()
        for b in batches:
            *kept, text, _, runs, items = b.columns
            runs, items = runs.to_pylist(), items.to_pylist()
            n_words = np.zeros(len(b), np.int64)
            for i, j, w in word_chunks(text, ALNUM_WORDS):
                n_words[i:j] = np.diff(w.first)
                found = defaultdict(list)
                for doc, a, e, x in block.find(w):
                    found[i + doc].append((a, e))
                    items[i + doc] = items[i + doc] + [s for s in block.items[x] if s not in items[i + doc]]
                for row, spans in found.items():
                    old = runs[row]
                    out: list[int] = []
                    for a, e in sorted([*spans, *zip(old[::2], old[1::2])]):
                        if out and a <= out[-1]:
                            out[-1] = max(out[-1], e)
                        else:
                            out += [a, e]
                    runs[row] = out
            yield pa.RecordBatch.from_arrays([*kept, text, pa.array(n_words), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], b.schema.names)

    return run


def contamination_digest(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: `contaminated_words` in figures, a row for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df = contaminated_words(rows, items, width)
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return df.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
