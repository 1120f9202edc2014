"""Byte-pair encoding by prefix dynamic programming.

For every prefix of a piece of text the encoder stores the last token of that prefix's encoding and its token count. The
last token of prefix i is the one token t, found among the automaton's matches that end at i, for which the last token of
prefix i - len(t) and t are a compatible pair: the two, merged on their own, stay as they are. So one pass from the left
gives the count of every prefix, and the ids come from walking back along the last tokens.

`ByteTable` takes the same pass over many short pieces at a time, a place of all of them after the other.
"""

from __future__ import annotations

import json

import numpy as np


class PrefixEncoder:
    """pieces: token strings by id (None: not to be matched). rank(left, right): priority of a merge, lower first, or None."""

    def __init__(self, pieces: list[str | None], rank):
        import ahocorasick

        self.pieces, self.rank = pieces, rank
        self.length = [len(p or "") for p in pieces]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        #: the two halves that a token's own encoding merges last, by id (of a letter: itself)
        self.halves: dict[int, list[str]] = {}
        for i, p in enumerate(pieces):
            parts = self.merged(p, 2) if p else []
            if len(parts) == 1 or len(parts) == 2 and rank(*parts) is not None:
                self.automaton.add_word(p, (i, len(p)))
                self.halves[i] = parts
        self.automaton.make_automaton()
        self.letters = {p for p in pieces if p and len(p) == 1}
        self.fits: dict[int, bool] = {}

    def merged(self, s: str, least: int = 1) -> list[str]:
        """The tokens of a short string, merge by merge: lowest rank first, then leftmost. No merge leaves fewer than `least`."""
        parts = list(s)
        rank = self.rank
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, key: int) -> bool:
        a, b = self.pieces[key >> 20], self.pieces[key & 0xFFFFF]
        ok = self.fits[key] = self.merged(a + b) == [a, b]
        if len(self.fits) > 1_500_000:  # bounds a worker's memory; pairs are tested again when needed
            self.fits.clear()
        return ok

    def last_tokens(self, s: str) -> list[int]:
        """For each i in 0..len(s), the last token of the encoding of s[:i] (-1 at 0). All of s must be in the vocabulary's letters."""
        last = [-1] * (len(s) + 1)
        fits = self.fits
        for end, (tok, n) in self.automaton.iter(s):
            i = end + 1
            if last[i] < 0:
                p = i - n
                if p:
                    key = last[p] << 20 | tok
                    ok = fits.get(key)
                    if ok is None:
                        ok = self._pair(key)
                    if not ok:
                        continue
                last[i] = tok
        return last

    def ids(self, s: str) -> list[int]:
        last, i, out, length = self.last_tokens(s), len(s), [], self.length
        while i:
            t = last[i]
            out.append(t)
            i -= length[t]
        out.reverse()
        return out

    def counts(self, s: str) -> np.ndarray:
        """Token count of every prefix s[:i], i = 0..len(s)."""
        last, length = self.last_tokens(s), self.length
        out = np.zeros(len(last), np.int64)
        for i in range(1, len(last)):
            out[i] = out[i - length[last[i]]] + 1
        return out


class ByteTable:
    """Token counts of many short byte strings at a time, by arrays: a dense table of the vocabulary's prefixes, and for the merges and
    the pairs met one place each, found by a hash.

    A pair is compatible if none of the merges across it comes before the merges that made what it joins; these are undone from the
    latest on, by the halves of each token.
    """

    #: Bits of the places for pairs met; a pair that meets another's place takes it, and is tested again when needed.
    PLACES = 20

    def __init__(self, encoder: PrefixEncoder, merges: dict[tuple[str, str], int]):
        ids = {encoder.pieces[i]: i for i in encoder.halves}
        n = len(encoder.pieces)
        self.made = np.full(n, -1)  # the rank of the merge that makes a token, -1 for letters
        self.left, self.right = np.arange(n), np.arange(n)
        for i, parts in encoder.halves.items():
            if len(parts) == 2:
                self.made[i], self.left[i], self.right[i] = merges[tuple(parts)], ids[parts[0]], ids[parts[1]]
        joined = np.flatnonzero(self.made >= 0)
        #: whether each token comes after its halves, so that undoing by rank is undoing in time, and all bytes are letters
        self.ordered = bool((self.made[joined] > np.maximum(self.made[self.left[joined]], self.made[self.right[joined]])).all()) and all(chr(b) in ids for b in range(256))
        node = {"": 1}
        for p in ids:  # inner nodes first, so that only they have a row of children
            for k in range(1, len(p)):
                node.setdefault(p[:k], len(node) + 1)
        self.inner = len(node) + 1
        for p in ids:
            node.setdefault(p, len(node) + 1)
        self.child = np.zeros(self.inner * 256, np.int32)
        self.token = np.full(len(node) + 1, -1, np.int32)
        for p, k in node.items():
            if p:
                self.child[node[p[:-1]] * 256 + ord(p[-1])] = k
                self.token[k] = ids.get(p, -1)
        known = [(ids[a] << 20 | ids[b], r) for (a, b), r in merges.items() if a in ids and b in ids]
        keys, ranks = (np.array(c, np.int64) for c in zip(*known)) if known else (np.empty(0, np.int64),) * 2
        self.bits = max(8, (8 * len(keys)).bit_length())
        self.merge_key, self.merge_rank = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        at, rest = self._place(keys, self.bits), np.arange(len(keys))
        while len(rest):
            free = rest[self.merge_key[at[rest]] < 0]
            self.merge_key[at[free]] = keys[free]
            put = self.merge_key[at[rest]] == keys[rest]
            self.merge_rank[at[rest[put]]] = ranks[rest[put]]
            rest = rest[~put]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
        self.met = np.full(1 << self.PLACES, -1)  # key * 2 + whether it is compatible

    @staticmethod
    def _place(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of merges; -1 where two tokens have none."""
        at = self._place(keys, self.bits)
        out = np.full(len(keys), -1)
        rest = np.arange(len(keys))
        while len(rest):
            found = self.merge_key[at[rest]]
            same = found == keys[rest]
            out[rest[same]] = self.merge_rank[at[rest[same]]]
            rest = rest[~same & (found >= 0)]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Of pairs (left << 20 | right), whether the two tokens, merged on their own, stay as they are."""
        ok, rest = np.ones(len(keys), bool), np.arange(len(keys))
        a, b, limit = keys >> 20, keys & 0xFFFFF, np.full(len(keys), np.iinfo(np.int64).max)
        while len(rest):
            rank = self._rank(a << 20 | b)
            crossed = (rank >= 0) & (rank < limit)
            ok[rest[crossed]] = False
            made_a, made_b = self.made[a], self.made[b]
            on = ~crossed & ((made_a >= 0) | (made_b >= 0))
            rest, a, b, made_a, made_b = rest[on], a[on], b[on], made_a[on], made_b[on]
            # equal merges go from left to right, so one across the pair comes after that of the left token and before that of the right one
            left = made_a > made_b
            limit = np.where(left, made_a, made_b + 1)
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
        return ok

    def _fits(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys, self.PLACES)
        met = self.met[at]
        out = (met & 1).astype(bool)
        new = np.flatnonzero(met >> 1 != keys)
        if len(new):
            some, where = np.unique(keys[new], return_inverse=True)
            ok = self.compatible(some)
            out[new] = ok[where]
            self.met[self._place(some, self.PLACES)] = some << 1 | ok
        return out

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece. What is held is the bytes of the longest piece for each."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not len(pieces) or not length.max():
            return np.zeros(len(pieces), np.int64)
        order = np.argsort(-length, kind="stable")
        size, most = length[order], int(length.max())
        data = np.frombuffer(b"".join([pieces[i] for i in order.tolist()]), np.uint8)
        column = np.repeat(np.arange(len(size)), size)
        letters = np.zeros((most, len(size)), np.uint8)
        letters[np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size), column] = data
        active = np.searchsorted(-size, -np.arange(most), "left")  # pieces longer than 0, 1, ...
        last, count = np.zeros((most + 1, len(size)), np.int32), np.zeros((most + 1, len(size)), np.int32)
        for p in range(most):
            at = np.arange(active[p])
            node = np.ones(len(at), np.int64)
            found = []
            for end in range(p, most):
                node = self.child[node * 256 + letters[end, at]]
                token = self.token[node]
                match = np.flatnonzero(token >= 0)
                found.append((at[match], token[match], np.full(len(match), end + 1)))
                on = np.flatnonzero((node > 0) & (node < self.inner) & (at < (active[end + 1] if end + 1 < most else 0)))
                if not len(on):
                    break
                at, node = at[on], node[on].astype(np.int64)
            at, token, end = (np.concatenate(c) for c in zip(*found))
            if p:
                fit = self._fits(last[p, at].astype(np.int64) << 20 | token)
                at, token, end = at[fit], token[fit], end[fit]
            last[end, at] = token
            count[end, at] = count[p, at] + 1
        out = np.empty(len(size), np.int64)
        out[order] = count[size, np.arange(len(size))]
        return out


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level(model: bytes) -> tuple[PrefixEncoder, ByteTable, dict[str, int]]:
    """Encoder over bytes (each a latin-1 letter) of a byte-level .json vocabulary, its table, and its special strings with their ids."""
    spec = json.loads(model)
    letters = _byte_letters()
    plain = lambda p: "".join(chr(letters[c]) for c in p)
    vocab = spec["model"]["vocab"]
    pieces: list[str | None] = [None] * (max(vocab.values()) + 1)
    for p, i in vocab.items():
        if all(c in letters for c in p):
            pieces[i] = plain(p)
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ranks = {(plain(a), plain(b)): i for i, (a, b) in enumerate(merges)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
    encoder = PrefixEncoder(pieces, lambda a, b: ranks.get((a, b)))
    return encoder, ByteTable(encoder, ranks), special


def sentence_piece(model: bytes) -> tuple[PrefixEncoder, list[int]]:
    """Encoder over characters of a sentencepiece BPE .model, and the ids of its 256 byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    pieces = [sp.id_to_piece(i) if normal[i] else None for i in range(n)]
    cost = {p: -sp.get_score(i) for i, p in enumerate(pieces) if p}
    return PrefixEncoder(pieces, lambda a, b: cost.get(a + b)), [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
