"""Language identification by a byte convolutional network in numpy.

Bytes (A-Z lower-cased) are embedded, convolved with filters of several widths, max-pooled over a window and put through a
softmax. A text is cut into consecutive windows of fixed length, all of it; its probabilities are the windows' mean, weighted by
their bytes. The network is trained on the driver from a bounded sample of labelled rows: `per_language` rows of each of the
`most_languages` most frequent languages and WINDOWS windows a row, parameters of `fit`. Everything else covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean_batches, let_go

WINDOW = 256
WIDTHS = (2, 3, 4)
#: Places of a window at which all filters are applied.
PLACES = WINDOW - 3
DIM, FILTERS = 8, 16
#: Bounds of the training sample: rows a language, windows a row, languages.
PER_LANGUAGE, WINDOWS, MOST_LANGUAGES = 400, 3, 200
EPOCHS, BATCH, RATE, SEED = 6, 64, 2e-3, 7
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class ByteNet:
    languages: list[str]
    weights: dict[str, np.ndarray]
    _tables: tuple | None = None

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The convolutions' partial sums for every byte pair: all filters on a pair at their first place, those of width 4 on
        a pair at its third, and those of width 3 on a byte at its third."""
        if self._tables is None:
            w = self.weights
            part = {(k, o): w["embed"] @ w[f"conv{k}"][o * DIM : (o + 1) * DIM] for k in WIDTHS for o in range(k)}
            pair = lambda k, o: (part[k, o][:, None] + part[k, o + 1][None]).reshape(1 << 16, FILTERS)
            self._tables = np.concatenate([pair(k, 0) for k in WIDTHS], 1), pair(4, 2), part[3, 2]
        return self._tables

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """x: (windows, WINDOW) bytes -> (windows, filters of all widths), the largest response of each."""
        first, third, byte = self.tables()
        pair = x[:, :-1].astype(np.intp) << 8 | x[:, 1:]
        out = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        for i in range(0, len(x), 16):  # so that the responses stay in the CPU's cache
            r = first[pair[i : i + 16, :PLACES]]
            r[:, :, FILTERS : 2 * FILTERS] += byte[x[i : i + 16, 2 : 2 + PLACES]]
            r[:, :, 2 * FILTERS :] += third[pair[i : i + 16, 2 : 2 + PLACES]]
            r.max(1, out=out[i : i + 16])
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x) + self.weights["bias"], 0) @ self.weights["out"] + self.weights["out_bias"]
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train(windows: np.ndarray, label: np.ndarray, languages: list[str]) -> ByteNet:
    """Adam on cross-entropy; max pooling passes the gradient to the winning position."""
    rng = np.random.default_rng(SEED)
    c, total = len(languages), FILTERS * len(WIDTHS)
    w = {"embed": rng.normal(0, 0.5, (256, DIM)), "bias": np.zeros(total), "out": rng.normal(0, 0.3, (total, c)), "out_bias": np.zeros(c)}
    w |= {f"conv{k}": rng.normal(0, (2 / (k * DIM)) ** 0.5, (k * DIM, FILTERS)) for k in WIDTHS}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    share = np.bincount(label, minlength=c) / len(label)
    weight = (1 / np.maximum(share, 1e-9) / c)[label].astype(np.float32)  # languages count alike
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            x, y, n = windows[at], label[at], len(at)
            e = w["embed"][x]
            views, best, top = {}, {}, []
            for k in WIDTHS:
                views[k] = np.lib.stride_tricks.as_strided(e, (n, PLACES, k * DIM), e.strides)
                r = (views[k].reshape(-1, k * DIM) @ w[f"conv{k}"]).reshape(n, PLACES, FILTERS)
                best[k] = r.argmax(1)
                top.append(np.take_along_axis(r, best[k][:, None], 1)[:, 0])
            h = np.concatenate(top, 1) + w["bias"]
            a = np.maximum(h, 0)
            z = a @ w["out"] + w["out_bias"]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y] -= 1
            p *= weight[at][:, None] / n
            g = {"out": a.T @ p, "out_bias": p.sum(0), "embed": np.zeros_like(w["embed"])}
            dh = (p @ w["out"].T) * (h > 0)
            g["bias"] = dh.sum(0)
            rows = np.arange(n)[:, None]
            for j, k in enumerate(WIDTHS):
                d = dh[:, j * FILTERS : (j + 1) * FILTERS]
                seen = views[k][rows, best[k]]  # (n, filters, k * DIM)
                g[f"conv{k}"] = np.einsum("nf,nfd->df", d, seen)
                back = (d[:, :, None] * w[f"conv{k}"].T[None]).reshape(n, FILTERS, k, DIM)
                np.add.at(g["embed"], x[rows[:, :, None], best[k][:, :, None] + np.arange(k)], back)
            step += 1
            for key, grad in g.items():
                m[key] = 0.9 * m[key] + 0.1 * grad
                v[key] = 0.999 * v[key] + 0.001 * grad * grad
                w[key] -= (RATE * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteNet(languages, w)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def _padded(data: bytes) -> np.ndarray:
    x = np.zeros(WINDOW, np.uint8)
    cut = np.frombuffer(data[:WINDOW], np.uint8)
    x[: len(cut)] = _FOLD[cut]
    return x


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> ByteNet | None:
    """Trained from rows (doc_id, text, lang) with a lang and a letter in the text; None if there are none.

    Of each language the rows of lowest hash are taken, `per_language` at most, and WINDOWS windows at hashed places of each.
    Both bounds are of the labelled sample alone: a language beyond the `most_languages` most frequent ones is not learned.
    """
    rows = labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return None
    u = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, 2.0 * per_language / r["count"]) * (1 << 30)))])
    starts = F.expr(f"transform(sequence(0, {WINDOWS - 1}), i -> cast(1 + pmod(xxhash64(doc_id, i), greatest(length(text) - {WINDOW - 1}, 1)) as int))")
    cuts = rows.where(u <= share[F.col("lang")]).select("lang", u.alias("u"), F.expr("doc_id"), F.transform(starts, lambda i: F.substring(F.col("text"), i, WINDOW)).alias("cuts"))
    taken: dict[str, int] = {}
    x, y, names = [], [], sorted(r["lang"] for r in counts)
    for r in cuts.orderBy("u", "doc_id").limit(4 * per_language * len(counts)).collect():
        if taken.get(r["lang"], 0) < per_language:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            for s in dict.fromkeys(r["cuts"]):
                x.append(_padded(s.encode("utf-8", "surrogatepass")))
                y.append(names.index(r["lang"]))
    return train(np.array(x), np.array(y), names)


def predictions(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """All rows and columns of `docs` with lang_pred and score, from `text` alone.

    A null text, or one without a letter, is `und` with score 0, as is every text if there is no network. Columns of `docs`
    named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    lean_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        net = held.value
        let_go()
        for b in batches:
            texts = b.column(at).to_pylist()
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            wins, owner, size = [], [], []

            def flush():
                if not wins:
                    return
                p = net.probabilities(np.concatenate(wins))
                total = np.zeros((len(texts), p.shape[1]))
                np.add.at(total, np.repeat(owner, [len(w) for w in wins]), p * np.concatenate(size)[:, None])
                sums.__iadd__(total)
                wins.clear(), owner.clear(), size.clear()

            if net is not None:
                sums, n = np.zeros((len(texts), len(net.languages))), 0
                for i, t in enumerate(texts):
                    if not t or not _LETTER.search(t):
                        continue
                    data = _FOLD[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)]
                    for j in range(0, len(data), 64 * WINDOW):
                        cut = data[j : j + 64 * WINDOW]
                        k = -(-len(cut) // WINDOW)
                        win = np.zeros(k * WINDOW, np.uint8)
                        win[: len(cut)] = cut
                        wins.append(win.reshape(k, WINDOW))
                        owner.append(i)
                        size.append(np.minimum(len(cut) - np.arange(k) * WINDOW, WINDOW))
                        n += k
                        if n >= 128:
                            flush()
                            n = 0
                flush()
                known = sums.sum(1) > 0
                p = sums / np.maximum(sums.sum(1, keepdims=True), 1e-12)
                for i in np.flatnonzero(known):
                    pred[i] = net.languages[int(p[i].argmax())]
                score = np.where(known, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred), pa.array(np.clip(score, 0, 1))], [*b.schema.names, "lang_pred", "score"])

    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame, held_out: int = 2) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from rows with a lang whose crc32 remainder is not `held_out`; lang is no input of a prediction. A null doc_id is
    never learned from and not held out. Rows that repeat are predicted each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = fit(rows.where(remainder() != held_out))
    out = F.coalesce(remainder() == held_out, F.lit(False)).alias("held_out")
    return predictions(rows.select("doc_id", out, "text"), net).select("doc_id", "held_out", "lang_pred", "score")
