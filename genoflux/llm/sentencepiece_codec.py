"""SentencePiece encoding and decoding by a merge-type prefix table (prefix_bpe.py).

No piece of the vocabulary has a word's start mark after another character, so a text's words are encoded on their own: the
table stores each prefix's unique last token, and ids are recovered backwards. A word's ids are kept for its next occurrence, as is
whether they decode to the word itself; a text of such words decodes to itself. Characters without a piece become their bytes'
pieces. Decoding joins the pieces, turns marks into blanks, reads byte pieces as UTF-8 and drops the blank put before the text.
"""

from __future__ import annotations

import re
from hashlib import sha256
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_by_worker, lean_batches, string_buffers
from .prefix_bpe import sentence_piece

MARK = "▁"
#: Words a worker keeps, of either kind.
KEPT = 150_000
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Codec:
    def __init__(self, model: bytes):
        self.encoder, self.byte_ids = sentence_piece(model)
        crossing = [p for p in self.encoder.pieces if p and MARK in p.lstrip(MARK)]
        if crossing or any("\n" in (p or "") for p in self.encoder.pieces):
            raise ValueError("this vocabulary has pieces across words or lines; its words can't be encoded on their own")
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.end = f",{self.byte_ids[10]}"
        self.marked: dict[str, str] = {}
        self.bare: dict[str, str] = {}
        #: words whose ids decode to something else
        self.odd: set[str] = set()

    def unit_ids(self, unit: str) -> list[int]:
        letters = self.encoder.letters
        if letters.issuperset(unit):
            return self.encoder.ids(unit)
        out, part = [], ""
        for c in unit:
            if c in letters:
                part += c
                continue
            out += self.encoder.ids(part) if part else []
            out += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
            part = ""
        return out + (self.encoder.ids(part) if part else [])

    def decoded(self, ids: list[int]) -> str:
        """The text of ids, with the blank before it if they begin with a mark."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append((self.encoder.pieces[i] or "").replace(MARK, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decoded(ids)
        return text[1:] if text[:1] == " " else text

    def _unit(self, kept: dict[str, str], key: str, unit: str) -> str:
        """The ids of a unit that `kept` lacks, each after a comma."""
        ids = self.unit_ids(unit)
        if len(kept) >= KEPT:
            kept.clear()
            if len(self.odd) >= KEPT:  # together, so that no kept word's oddness is forgotten
                self.marked.clear(), self.bare.clear(), self.odd.clear()
        if self.decoded(ids) != unit.replace(MARK, " "):
            self.odd.add(key)
        got = kept[key] = "".join([f",{i}" for i in ids])
        return got

    def both(self, text: str) -> tuple[str, str]:
        """The ids, each after a comma, and the text decoded from them."""
        if not text:
            return "", ""
        parts: list[str] = []
        if MARK not in text and text[0] != " ":
            marked, bare, end = self.marked, self.bare, self.end
            for k, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if k:
                    parts.append(end)
                    first = words[0]
                    if first:
                        parts.append(bare.get(first) or self._unit(bare, first, first))
                    del words[0]
                elif not words[0]:  # the text begins with a line end: its mark stands alone
                    parts.append("".join([f",{i}" for i in self.unit_ids(MARK)]))
                    del words[0]
                if "" in words:
                    parts = []
                    break
                parts += [marked.get(w) or self._unit(marked, w, MARK + w) for w in words]
            if parts and (not self.odd or self.odd.isdisjoint(text.replace("\n", " ").split(" "))):
                return "".join(parts), text
        ids: list[int] = []
        for unit in _UNITS.findall(MARK + text.replace(" ", MARK)):
            ids += self.unit_ids(unit)
        return "".join([f",{i}" for i in ids]), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        return self.encoded(text)[0].tolist()

    def encoded(self, text: str) -> tuple[np.ndarray, str]:
        """The ids and the text decoded from them."""
        ids, shown = self.both(text)
        return np.fromstring(ids[1:], np.int32, sep=",") if ids else np.empty(0, np.int32), shown


def _codec(model: bytes) -> Codec:
    return held_by_worker(("sentencepiece", hash(model)), lambda: Codec(model))


#: Bytes of text whose results a worker holds at a time, one row at least.
SLICE = 1 << 18


def _mapped(docs: DataFrame, model_path: str, one, schema: str) -> DataFrame:
    """one(codec, text) -> the output columns after doc_id, over all rows."""
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    lean_batches(docs.sparkSession)

    def column(values, kind):
        import pyarrow as pa

        if kind == "array<int>":
            ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
        return pa.array(values, {"long": pa.int64(), "string": pa.string()}[kind])

    def run(batches):
        import pyarrow as pa

        codec = _codec(model.value)
        for b in batches:
            _, off, _ = string_buffers(b.column(1))
            for i, j in chunks(off, SLICE):
                part = b.slice(i, j - i)
                rows = [one(codec, x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(column(c, kind) for c, kind in zip(zip(*rows), kinds))], names)

    fields = [x.strip().split(" ") for x in schema.split(", ")]
    names, kinds = ["doc_id", *(n for n, _ in fields)], [k for _, k in fields]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {schema}")


def _digest(codec: Codec, text: str):
    ids, shown = codec.both(text)
    return ids.count(","), sha256(ids[1:].encode()).hexdigest(), sha256(shown.encode("utf-8", "surrogatepass")).hexdigest()


def round_trip_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256. A null text is encoded
    as the empty one (no ids). Rows that repeat are encoded each; other columns are ignored."""
    return _mapped(docs, model_path, _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, decoded for each row of `docs` (doc_id, text); a null text is encoded as the empty one."""
    return _mapped(docs, model_path, Codec.encoded, "ids array<int>, decoded string")
