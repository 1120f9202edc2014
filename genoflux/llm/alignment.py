"""Alignment of two tokenizers over the same bytes, by interval coalescing.

Both encodings of a text tile its bytes. All tokens of both are sorted by where they start, and the running maximum of their
ends is taken: a group of tokens ends where the next start reaches that maximum, and tokens of one group overlap only each
other. Links are all pairs of an A and a B token of a group. How many documents hold a pair of ids linked is counted over all
documents, and each document then reads its own pairs' counts.

Both encodings have a cut before a blank or line end that follows a word, so groups don't cross it: a unit, that is a word and what it
begins with, is aligned once, and a text's groups are those of its units in a row. Texts with other white space are aligned whole.

A is a byte-level .json vocabulary, which encodes a blank and the text; B a sentencepiece .model, which puts the blank itself.
"""

from __future__ import annotations

import os
import re
from functools import cache
from hashlib import sha256
from itertools import chain
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, held_by_worker, lean_batches, string_buffers
from .prefix_bpe import _byte_letters

#: No pre-tokeniser piece goes on from such a character to a blank or line end, so a text's units are encoded on their own. Characters
#: that some definition calls white space are never cut after.
CUT = re.compile("(?<=[^\\s\x1c-\x1f\x85᠎​⁠﻿])(?=[ \n])")
#: A unit that is aligned on its own, without the blank that it begins with if not with a line end.
ALONE = re.compile("\n?[^\\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff\u2581]+")
#: Units, and characters of them, whose ids or alignments a worker keeps.
KEPT, KEPT_CHARS = 300_000, 8_000_000
#: Units that A encodes in one run.
RUN = 24
#: A group of more pairs is counted by its distinct ids before they are paired.
PLAIN_GROUP = 1024
#: Pairs that are paired, and keys that are counted, at a time.
PAIRS, KEYS = 1 << 21, 1 << 21
#: Pairs of ids in the broadcast table, 17 bytes each. The others' counts are joined.
BROADCAST_PAIRS = 1 << 20


class Entries:
    """The byte strings of ids, and their concatenation over a sequence of ids."""

    def __init__(self, entries: list[bytes]):
        self.length = np.fromiter(map(len, entries), np.int64, len(entries))
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spans(self.first[ids], self.length[ids])]


def spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + length[i] - 1, one range after the other."""
    ends = np.cumsum(length)
    return np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


class ByteLevel:
    """Ids of texts (each with a blank put before it) by a byte-level vocabulary; special strings are plain text."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.tokenizer.encode_special_tokens = True
        letters, vocabulary = _byte_letters(), self.tokenizer.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            entries[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.entries = Entries(entries)
        self._clear()

    def _clear(self) -> None:
        self.kept: dict[str, int] = {}
        self.chars = 0
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        units = [CUT.split(" " + t) for t in texts]
        seen = set(chain.from_iterable(units))
        new = list(seen.difference(self.kept))
        if len(self.kept) + len(new) > KEPT or self.chars > KEPT_CHARS:
            self._clear()
            new = list(seen)
        if new:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.kept.update(zip(new, range(len(self.ends) - 1, len(self.ends) - 1 + len(new))))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.int32)])
            self.chars += sum(map(len, new))
        at = np.fromiter(map(self.kept.__getitem__, chain.from_iterable(units)), np.int64)
        length = self.ends[at + 1] - self.ends[at]
        last = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        total = np.concatenate([[0], np.cumsum(length)])[last]
        return self.ids[spans(self.ends[at], length)], np.diff(total, prepend=0)

    def alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of units (see ALONE). Runs of them are encoded, which is quicker, and cut where the bytes of a unit end."""
        shown = [u if u[0] == "\n" else " " + u for u in units]
        encode = lambda x: [e.ids for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(encode(["".join(shown[i : i + RUN]) for i in range(0, len(shown), RUN)])), np.int32)
        last, ends = np.cumsum([len(u.encode()) for u in shown]), np.cumsum(self.entries.length[ids])
        at = np.searchsorted(ends, last)
        if len(ends) and np.array_equal(ends[np.minimum(at, len(ends) - 1)], last):
            return ids, np.diff(at + 1, prepend=0)
        got = encode(shown)
        return np.fromiter(chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int64, len(got))


class Pieces:
    """Ids of texts by a sentencepiece model, which puts the blank before a text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        piece = self.model.id_to_piece
        self.entries = Entries([bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())])
        plain = [piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        #: whether no piece goes on to a blank or has a line end
        self.apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in plain)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.model.encode(texts, num_threads=1)
        return np.fromiter(chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int64, len(got))

    def alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.model.encode(units, num_threads=1)
        got = [ids[1:] if u[0] == "\n" else ids for u, ids in zip(units, got)]  # the blank put before a line end is none of the unit's
        return np.fromiter(chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int64, len(got))


def coalesced(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """The group of each token, those of A first. Groups are numbered by where they begin."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    new = np.ones(len(order), bool)
    new[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group


class Aligned:
    """The tokens of some texts, or of units that stand alone, in groups. Texts that a side can't give back byte by byte have no tokens."""

    def __init__(self, a: ByteLevel, b: Pieces, texts: list[str | None], alone: bool = False):
        n = len(texts)
        at = np.array([i for i, t in enumerate(texts) if t], np.int64)
        some = [texts[i] for i in at]
        raw = [t.encode() if alone and t[0] == "\n" else b" " + t.encode() for t in some]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        sides = []
        exact = np.ones(len(some), bool)
        for side in (a, b):
            ids, count = (side.alone if alone else side.encode)(some) if some else (np.empty(0, np.int32), np.empty(0, np.int64))
            text = np.repeat(np.arange(len(some)), count)
            size = np.bincount(text, side.entries.length[ids], len(some)).astype(np.int64)
            same = size == sizes
            if same.all():
                whole, joined = np.frombuffer(b"".join(raw), np.uint8), side.entries.joined(ids)
                same[np.searchsorted(np.cumsum(sizes), np.flatnonzero(whole != joined), "right")] = False
            else:
                first = np.cumsum(count) - count
                same &= np.array([same[i] and side.entries.joined(ids[first[i] : first[i] + count[i]]).tobytes() == raw[i] for i in range(len(some))], bool)
            exact &= same
            sides.append((ids, text))
        (self.a, text_a), (self.b, text_b) = ((ids[exact[text]], text[exact[text]]) for ids, text in sides)
        end_a, end_b = np.cumsum(a.entries.length[self.a]), np.cumsum(b.entries.length[self.b])
        group = coalesced(end_a - a.entries.length[self.a], end_a, end_b - b.entries.length[self.b], end_b)
        self.group_a, self.group_b = group[: len(self.a)], group[len(self.a) :]
        n_groups = int(group.max()) + 1 if len(group) else 0
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=n_groups), np.bincount(self.group_b, minlength=n_groups)
        self.first_a, self.first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        #: the row of each group
        self.row = at[text_a[self.first_a]] if n_groups else np.empty(0, np.int64)
        count = lambda rows, w=None: np.bincount(rows, w, n).astype(np.int64)
        self.n_a, self.n_b, self.n_groups = count(at[text_a]), count(at[text_b]), count(self.row)
        links = np.concatenate([[0], np.cumsum(self.in_a * self.in_b)])
        self.n_links = np.diff(links[np.concatenate([[0], np.cumsum(self.n_groups)])])
        self.width = len(b.entries.length)
        self.n = n

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct linked pairs of ids of each row, in order: row, key (A's id times the size of B's vocabulary, and B's
        id), and how many links of the row it has."""
        size = self.in_a * self.in_b
        plain = np.flatnonzero(size <= PLAIN_GROUP)
        out = []
        for i, j in chunks(np.concatenate([[0], np.cumsum(size[plain])]), PAIRS) if len(plain) else ():
            g = plain[i:j]
            nth = spans(np.zeros(len(g), np.int64), size[g])
            of = np.repeat(g, size[g])
            x, y = self.a[self.first_a[of] + nth // self.in_b[of]], self.b[self.first_b[of] + nth % self.in_b[of]]
            out.append(_counted(self.row[of], x.astype(np.int64) * self.width + y, None, self.n))
        for g in np.flatnonzero(size > PLAIN_GROUP):
            x, nx = np.unique(self.a[self.first_a[g] : self.first_a[g] + self.in_a[g]], return_counts=True)
            y, ny = np.unique(self.b[self.first_b[g] : self.first_b[g] + self.in_b[g]], return_counts=True)
            key, times = (x.astype(np.int64)[:, None] * self.width + y).ravel(), (nx[:, None] * ny).ravel()
            out.append((np.full(len(key), self.row[g]), key, times))
        if not out:
            none = np.empty(0, np.int64)
            return none, none, none
        if len(out) == 1:
            return out[0]
        return _counted(*(np.concatenate(c) for c in zip(*out)), self.n)

    def digests(self) -> list[str]:
        """Of each row, the sha256 of its groups as text; empty without tokens."""
        return [sha256(x).hexdigest() if x else "" for x in self.shown()]

    def shown(self) -> list[bytes]:
        """Of each row, its groups as text, `a1,a2|b1;a3|b2`."""
        side = np.repeat(np.array([0, 1], np.int8), [len(self.a), len(self.b)])
        group = np.concatenate([self.group_a, self.group_b])
        order = np.lexsort((side, group))  # stable: within a side, tokens stay in their order
        ids = np.concatenate([self.a, self.b])[order]
        decimals = _decimals(max(1, int(ids.max(initial=0))).bit_length())
        mark = np.full(len(ids), ord(","), np.uint8)
        side, group = side[order], group[order]
        mark[:-1][side[1:] != side[:-1]] = ord("|")
        mark[:-1][group[1:] != group[:-1]] = ord(";")
        width = decimals.length[ids] + 1
        ends = np.cumsum(width)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
        digit = np.ones(len(out), bool)
        digit[ends - 1] = False
        out[ends - 1] = mark
        out[digit] = decimals.joined(ids)
        last = np.concatenate([[0], ends])[np.cumsum(self.n_a + self.n_b)]
        shown, begin = [], 0
        for end in last.tolist():
            shown.append(out[begin : end - 1].tobytes() if end > begin else b"")
            begin = end
        return shown


def _counted(row, key, times, n):
    """Rows (below n) and keys in order, once each, and their sums of times (None: how often each is)."""
    order = np.lexsort((key, row)) if n >= 1 << 22 else np.argsort(row << 41 | key, kind="stable")
    row, key = row[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(row) else np.empty(0, np.int64)
    total = np.diff(np.append(first, len(row))) if times is None else np.add.reduceat(times[order], first) if len(first) else times
    return row[first], key[first], total


def _appended(held: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
    """`held` with `new` from place n on, and with twice the room when that runs out."""
    end = n + len(new)
    if end > len(held):
        room = np.empty((2 * end, *held.shape[1:]), held.dtype)
        room[:n] = held[:n]
        held = room
    held[n:end] = new
    return held


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Units:
    """Alignments of units, which a worker keeps, and of texts by them."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self._clear()

    def _clear(self) -> None:
        self.kept: dict[str, int] = {}
        self.chars = self.n_pairs = 0
        #: of each unit its groups as text, its counts, and where its pairs begin and how many it has; a text with unit 0 is aligned whole
        self.shown = [b""]
        self.counts, self.spans = np.zeros((1, len(COUNTS)), np.int64), np.zeros((1, 2), np.int64)
        self.key, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, units: set[str]) -> None:
        new = list(units.difference(self.kept))
        if self.kept and (len(self.kept) + len(new) > KEPT or self.chars > KEPT_CHARS):
            self._clear()
            new = list(units)
        self.kept.update(dict.fromkeys(new, 0))
        self.chars += sum(map(len, new))
        some = [u for u in new if ALONE.fullmatch(u)] if self.b.apart else []
        for i, j in chunks(np.cumsum([0, *map(len, some)])):
            got = Aligned(self.a, self.b, some[i:j], alone=True)
            row, key, times = got.pairs()
            n, size = len(self.shown), np.bincount(row, minlength=got.n)
            self.kept.update((u, n + k) for k, (u, tokens) in enumerate(zip(some[i:j], got.n_a.tolist())) if tokens)
            self.counts = _appended(self.counts, n, np.stack([getattr(got, c) for c in COUNTS], 1))
            self.spans = _appended(self.spans, n, np.stack([self.n_pairs + np.cumsum(size) - size, size], 1))
            self.key, self.times = _appended(self.key, self.n_pairs, key), _appended(self.times, self.n_pairs, times)
            self.n_pairs += len(key)
            self.shown += got.shown()

    def aligned(self, texts: list[str | None]):
        """Of each text its counts and digest; and row, key and times of all as `Aligned.pairs` gives them."""
        n = len(texts)
        units = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        self._learn(set(chain.from_iterable(units)))
        length = np.fromiter(map(len, units), np.int64, n)
        at = np.fromiter(map(self.kept.__getitem__, chain.from_iterable(units)), np.int64, length.sum())
        ends, row = np.cumsum(length), np.repeat(np.arange(n), length)
        whole = np.bincount(row[at == 0], minlength=n) > 0
        total = np.zeros((len(at) + 1, len(COUNTS)), np.int64)
        np.cumsum(self.counts[at], axis=0, out=total[1:])
        counts = total[ends] - total[ends - length]
        digests, places, shown = [], at.tolist(), self.shown.__getitem__
        for i, j, w in zip((ends - length).tolist(), ends.tolist(), whole.tolist()):
            digests.append("" if w or i == j else sha256(b";".join(map(shown, places[i:j]))).hexdigest())
        by_unit = ~whole[row]
        held, often = np.unique(row[by_unit] * len(self.shown) + at[by_unit], return_counts=True)
        row, at = np.divmod(held, len(self.shown))
        first, size = self.spans[at].T
        where = spans(first, size)
        pairs = _counted(np.repeat(row, size), self.key[where], np.repeat(often, size) * self.times[where], n)
        if whole.any():
            rows = np.flatnonzero(whole)
            got = Aligned(self.a, self.b, [texts[i] for i in rows])
            counts[rows] = np.stack([getattr(got, c) for c in COUNTS], 1)
            for i, digest in zip(rows.tolist(), got.digests()):
                digests[i] = digest
            row, key, times = got.pairs()
            pairs = tuple(map(np.concatenate, zip(pairs, (rows[row], key, times))))
            order = np.argsort(pairs[0], kind="stable")
            pairs = tuple(c[order] for c in pairs)
        return counts, digests, pairs


@cache
def _decimals(bits: int) -> Entries:
    return Entries([str(i).encode() for i in range(1 << bits)])


def _binary(values: np.ndarray, rows: np.ndarray, n: int):
    """An Arrow binary column of n rows from values in order of rows."""
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys (int64, ascending)
    and times (int64) as binary: the distinct linked pairs of ids and how many links each has.

    A text that is null or empty, or that a tokenizer doesn't give back byte by byte, has no tokens: zeros, and '' for the digest.
    Texts are aligned whole, however long; what a task holds is one slice of 512 KB or one longer text, with its pairs. Rows that repeat are
    aligned each; other columns are ignored; an empty table gives an empty one. The vocabulary files (about 2 MB) are read on
    the driver and broadcast.
    """
    lean_batches(docs.sparkSession)
    models = docs.sparkSession.sparkContext.broadcast(tuple(Path(p).read_bytes() for p in (a_path, b_path)))

    def run(batches):
        import pyarrow as pa

        units = held_by_worker(("alignment", *map(hash, models.value)), lambda: Units(ByteLevel(models.value[0]), Pieces(models.value[1])))
        for batch in batches:
            _, off, _ = string_buffers(batch.column(1))
            for i, j in chunks(off):
                part = batch.slice(i, j - i)
                counts, digests, (row, key, times) = units.aligned(part.column(1).to_pylist())
                counts = [pa.array(c, pa.int64()) for c in counts.T]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digests, pa.string()), _binary(key, row, j - i), _binary(times, row, j - i)], names)

    names = ["doc_id", *COUNTS, "groups_sha256", "keys", "times"]
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "groups_sha256 string, keys binary, times binary"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """key, n: how many rows of `links` (keys) hold each pair. A task counts up to KEYS keys at a time and keeps as many distinct ones."""

    def run(batches):
        import pyarrow as pa

        held, waiting, rows = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

        def merged():
            key, n = np.unique(np.concatenate(waiting), return_counts=True)
            key, where = np.unique(np.concatenate([held[0], key]), return_inverse=True)
            return key, np.bincount(where, np.concatenate([held[1], n]), len(key)).astype(np.int64)

        def out():
            for i in range(0, len(held[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)], pa.int64()) for c in held], ["key", "n"])

        for batch in batches:
            for value in batch.column(0):
                waiting.append(np.frombuffer(value.as_buffer() or b"", np.int64))
                rows += len(waiting[-1])
                if rows >= KEYS:
                    held, waiting, rows = merged(), [], 0
                    if len(held[0]) >= KEYS:
                        yield from out()
                        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        if waiting:
            held = merged()
        yield from out()

    return links.select("keys").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _least_broadcast(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most `most` pairs have that many documents or more."""
    sizes = {r.log: r.pairs for r in counts.groupBy(F.expr("cast(floor(log2(n)) as int)").alias("log")).agg(F.count("*").alias("pairs")).collect()}
    at = max(sizes, default=0) + 1
    total = 0
    while at > 0 and total + sizes.get(at - 1, 0) <= most:
        at -= 1
        total += sizes.get(at, 0)
    return 1 << at


def scored(links: DataFrame, counts: DataFrame, width: int, scratch: Scratch, most: int = BROADCAST_PAIRS) -> DataFrame:
    """`links` (a written table of `aligned`) with n_best and count_sum in place of keys and times. counts: of `pair_counts`, written;
    width: the size of B's vocabulary.

    At most `most` pairs, those of most documents, are broadcast as arrays, so that no frequent pair is a key of a join; what a
    document holds of the others is joined with their counts and summed up per row.
    """
    best = counts.groupBy(F.expr(f"key div {width}").alias("a")).agg(F.max("n").alias("top"))  # one row an id of A's vocabulary
    marked = scratch.write(counts.withColumn("a", F.expr(f"key div {width}")).join(F.broadcast(best), "a").select("key", "n", (F.col("n") == F.col("top")).alias("best")))
    least = _least_broadcast(counts, most)
    hot = marked.where(F.col("n") >= least).toArrow()
    order = np.argsort(hot["key"].to_numpy())
    table = links.sparkSession.sparkContext.broadcast(tuple(hot[c].to_numpy()[order] for c in ("key", "n", "best")))

    def run(batches):
        import pyarrow as pa

        key, n, top = table.value
        for batch in batches:
            names = batch.schema.names
            keys, times = (np.concatenate([np.frombuffer(v.as_buffer() or b"", np.int64) for v in batch.column(names.index(c))] or [np.empty(0, np.int64)]) for c in ("keys", "times"))
            length = np.fromiter((len(v.as_buffer() or b"") // 8 for v in batch.column(names.index("keys"))), np.int64, batch.num_rows)
            row = np.repeat(np.arange(batch.num_rows), length)
            at = np.minimum(np.searchsorted(key, keys), max(len(key) - 1, 0))
            known = key[at] == keys if len(key) else np.zeros(len(keys), bool)
            ends = np.concatenate([[0], np.cumsum(length)])

            def total(values):  # int64 sums of each row
                return np.diff(np.concatenate([[0], np.cumsum(values)])[ends])

            m, r = (n[at] * known, top[at] & known) if len(key) else (np.zeros(len(keys), np.int64), known)
            rest = ~known
            columns = [batch.column(names.index(c)) for c in names if c not in ("keys", "times")]
            columns += [pa.array(total(times * r), pa.int64()), pa.array(total(times * m), pa.int64()), _binary(keys[rest], row[rest], batch.num_rows), _binary(times[rest], row[rest], batch.num_rows)]
            yield pa.RecordBatch.from_arrays(columns, out)

    rows = links.withColumn("row", F.monotonically_increasing_id())
    plain = [f for f in rows.schema.fields if f.name not in ("keys", "times")]
    out = [*(f.name for f in plain), "n_best", "count_sum", "keys", "times"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain), "n_best long, count_sum long, keys binary, times binary"])
    first = rows.mapInArrow(run, schema)
    if least == 1:  # all pairs are in the table
        return first.drop("keys", "times", "row")
    first = scratch.write(first)
    rest = first.where("length(keys) > 0").select("row", "keys", "times").mapInArrow(_unpacked, "row long, key long, times long")
    rest = rest.join(marked.where(F.col("n") < least), "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = first.drop("keys", "times").join(rest, "row", "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).drop("row", "more_best", "more_sum")


def _unpacked(batches):
    import pyarrow as pa

    for batch in batches:
        row, keys, times = batch.columns
        for i in range(batch.num_rows):
            key, n = (np.frombuffer(c[i].as_buffer(), np.int64) for c in (keys, times))
            for j in range(0, len(key), 1 << 16):
                part = key[j : j + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row[i].as_py())), pa.array(part), pa.array(n[j : j + (1 << 16)])], ["row", "key", "times"])


def linked_scores(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """`aligned` without its pairs, and of each row n_best (links whose pair of ids is held by as many documents as any pair of the
    same A id, ties included) and count_sum (the documents that hold its pair, summed over links). Rows count as documents, so rows that
    repeat count each."""
    import sentencepiece

    scratch = Scratch(docs.sparkSession)
    links = scratch.write(aligned(docs, a_path, b_path))
    counts = scratch.write(pair_counts(links))
    return scored(links, counts, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size(), scratch)
