"""Token counts of byte-level BPE, by prefix dynamic programming (prefix_bpe.py).

A text is cut into units at each blank or line end that stands between two other characters: no piece of the vocabulary's
pre-tokeniser crosses such a place, so counts add up. A unit's count is that of its last prefix, and is kept for the next
time the unit occurs; the new units of a slice of texts are counted together. Texts with runs of blanks or unusual white space take the same encoder piece by piece.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_by_worker, lean_batches, string_buffers
from .prefix_bpe import byte_level

#: The pre-tokeniser's pattern (a fixed value of the vocabulary).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space that a unit may not have besides the blank that it begins with.
INNER = re.compile(r"[\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")
#: Units a worker keeps.
KEPT = 300_000
#: Bytes of texts whose units are learned at a time, one text at least; bytes of pieces that are counted together, and of those at most.
SLICE, SHORT, AT_ONCE = 1 << 20, 32, 1 << 15


class Counter:
    def __init__(self, model: bytes):
        self.encoder, self.table, self.special = byte_level(model)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept: dict[str, int | None] = {}

    def _piece(self, piece: str) -> int:
        s = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last, i, n, length = self.encoder.last_tokens(s), len(s), 0, self.encoder.length
        while i:
            i -= length[last[i]]
            n += 1
        return n

    def learn(self, texts: list[str | None]) -> None:
        """Counts what units of the texts aren't kept yet, together; `count` and `fitting` find them."""
        bare, after = set(), set()
        for text in texts:
            for line in (text or "").split("\n"):
                words = line.split(" ")
                bare.add(words[0])
                after.update(words[1:])
        units = bare | {" " + w for w in after}
        units -= {"", " "}
        new = list(units.difference(self.kept))
        if self.kept and len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = list(units)
        plain, other = [], []
        for u in new:
            (plain if u.isascii() and u[u[0] == " " :].isalpha() else other).append(u)
        self.kept.update(zip(plain, self._counts(plain)))
        odd = {u for u in other if INNER.search(u, 1 if u[0] == " " else 0)}
        self.kept.update(dict.fromkeys(odd))
        other = [u for u in other if u not in odd]
        # a line end is a piece of its own between units without one
        pieces = PIECE.findall("\n".join(other))
        some = list(set(pieces))
        known = dict(zip(some, self._counts(some)))
        known["\n"] = 0
        total = np.cumsum([0, *map(known.__getitem__, pieces)])
        ends = np.flatnonzero(np.fromiter(map("\n".__eq__, pieces), bool, len(pieces)))
        self.kept.update(zip(other, np.diff(total[[0, *ends, len(pieces)]]).tolist()))

    def _counts(self, pieces: list[str]) -> list[int]:
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out = np.zeros(len(data), np.int64)
        short = [i for i, d in enumerate(data) if len(d) <= SHORT] if self.table.ordered else []
        for i in range(0, len(short), AT_ONCE):
            part = short[i : i + AT_ONCE]
            out[part] = self.table.counts([data[k] for k in part])
        for i in set(range(len(data))).difference(short):
            out[i] = self._piece(pieces[i])
        return out.tolist()

    def _known(self, piece: str) -> int:
        """Tokens of a piece; those of letters or digits are kept as units (other pieces may hold white space of their own)."""
        n = self.kept.get(piece)
        if n is None:
            n = self._piece(piece)
            if piece[-1].isalnum():
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[piece] = n
        return n

    def _unit(self, unit: str) -> int | None:
        """Tokens of a unit; None where it has white space of its own, so that it may not stand alone."""
        body = unit[1:] if unit[:1] == " " else unit
        n = None if INNER.search(body) else sum(map(self._piece, PIECE.findall(unit)))
        if len(self.kept) >= KEPT:
            self.kept.clear()
        self.kept[unit] = n
        return n

    def count(self, text: str) -> int:
        if self.split and any(x in text for x in self.special):
            return sum(1 if x in self.special else self._plain(x) for x in self.split.split(text) if x)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace("\n", "\n ").split(" ")
        # a word that ends a line carries its \n; the next one has no blank before it
        total, kept, bare = 0, self.kept, True
        for w in words:
            if w[-1:] == "\n":
                w = w[:-1]
                end = True
            else:
                end = False
            if not w:
                return sum(map(self._known, PIECE.findall(text)))
            unit = w if bare else " " + w
            n = kept.get(unit, -1)
            if n == -1:
                n = self._unit(unit)
            if n is None:
                return sum(map(self._known, PIECE.findall(text)))
            total += n + end
            bare = end
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token count of text[:i] for every i = 0..len(text), special strings taken as plain text.

        Pieces that a longer text leaves as they are give their counts from the stored prefixes; where the pre-tokeniser
        would cut a prefix of the last piece otherwise (white space, contractions), that piece's prefixes are cut anew.
        """
        out = np.zeros(len(text) + 1, np.int64)
        done = 0
        for m in PIECE.finditer(text):
            piece, at = m[0], m.start()
            if regex.fullmatch(r" ?(\p{L}+|\p{N}+|[^\s\p{L}\p{N}']+)", piece):
                data = [len(c.encode("utf-8", "surrogatepass")) for c in piece]
                counts = self.encoder.counts(piece.encode("utf-8", "surrogatepass").decode("latin-1"))
                out[at + 1 : at + 1 + len(piece)] = done + counts[np.cumsum(data)]
                done += int(counts[-1])
            else:
                for j in range(1, len(piece) + 1):
                    out[at + j] = done + sum(map(self._piece, PIECE.findall(piece[:j])))
                done = int(out[at + len(piece)])
        for m in regex.finditer(r"\s+", text):  # a prefix that ends in white space has all of it in one piece
            data = [len(c.encode("utf-8")) for c in m[0]]
            counts = self.encoder.counts(m[0].encode("utf-8").decode("latin-1"))
            out[m.start() + 1 : m.end() + 1] = out[m.start()] + counts[np.cumsum(data)]
        return out

    def fitting(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens; a special string is kept whole or not at all.

        Whole units are passed by their counts; where the budget ends, the unit's stored prefix counts tell the place.
        """
        at = 0
        for part in self.split.split(text) if self.split and any(x in text for x in self.special) else [text]:
            if part in self.special:
                n, fits = 1, len(part) if budget >= 1 else 0
            else:
                n, fits = self._fitting(part, budget)
            at, budget = at + fits, budget - n
            if fits < len(part):
                break
        return at

    def _fitting(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens and characters of the longest prefix of a plain text; no more of it is read than that needs."""
        at, left, bare = 0, budget, True
        # each unit but an empty text has a token, so no more than budget + 1 are of interest
        for w in text.replace("\n", "\n ").split(" ", budget + 1) if text else []:
            end = w[-1:] == "\n"
            unit = w[:-1] if end else w
            if not unit or " " in unit or "\n" in unit:
                break
            unit = unit if bare else " " + unit
            n = self.kept.get(unit, -1)
            n = self._unit(unit) if n == -1 else n
            if n is None or n + end > left:
                break
            at, left, bare = at + len(unit) + end, left - n - end, end
        if bare and at:  # a line end may belong to a run of white space
            at, left = at - 1, left + 1
        # the rest begins where no piece is cut: its pieces are passed up to the one after the budget
        n, stop, before = 0, len(text), 0
        for m in PIECE.finditer(text, at):
            if n > left:
                stop = m.end()
                break
            if not text[m.start() - 1 : m.start()].isspace():  # no run of white space is cut here
                at, before = m.start(), n
            n += self._known(m[0])
        left -= before
        counts = self.prefix_counts(text[at:stop])
        j = int(np.flatnonzero(counts <= left)[-1])
        return budget - left + int(counts[j]), at + j


def _counter(model: bytes) -> Counter:
    return held_by_worker(("byte-level", hash(model)), lambda: Counter(model))


def token_counts(docs: DataFrame, model_path: str, limit: int) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), kept_chars: the
    characters of the longest prefix within the limit, read off the stored prefix counts (all of them where the text is within it).

    A null text counts as empty: no bytes, no tokens. Whole texts are counted, however long. Rows that repeat are counted each;
    other columns are ignored; an empty table gives an empty one. The vocabulary file (about 2 MB) is read on the driver and
    broadcast.
    """
    lean_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches):
        import pyarrow as pa

        counter = _counter(model.value)
        for b in batches:
            _, off, _ = string_buffers(b.column(1))
            n, fits = [], []
            for i, j in chunks(off, SLICE):
                texts = b.column(1).slice(i, j - i).to_pylist()
                counter.learn(texts)
                for x in texts:  # one after the other, while the text's units are kept
                    n.append(counter.count(x) if x else 0)
                    fits.append(len(x or "") if n[-1] <= limit else counter.fitting(x, limit))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(fits, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "kept_chars"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, kept_chars long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "kept_chars")


def truncate_to_budget(docs: DataFrame, model_path: str, budget: int) -> DataFrame:
    """doc_id, kept_chars, kept_text: the longest prefix of each text within `budget` tokens, read off its prefix counts."""
    lean_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def run(batches):
        import pyarrow as pa

        counter = _counter(model.value)
        for b in batches:
            n = [counter.fitting(x, budget) if x else 0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(1)], ["doc_id", "kept_chars", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, kept_chars long, text string").select("doc_id", "kept_chars", F.expr("substring(coalesce(text, ''), 1, cast(kept_chars as int))").alias("kept_text"))
