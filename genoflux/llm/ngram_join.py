"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct word 5-grams. Two sets link when their Jaccard similarity is 0.8
or more (any rational threshold may be given). Documents with equal sets are one node, so exact copies cost nothing later.

Candidates. Tokens get a class by how many sets hold them: 0 one set, 1 rare, 2 frequent. All sets use one order: class,
then hash. Let `miss` be the most tokens a set of n can lack of a partner, floor(n * (1 - t)), and `wide` the bound
floor(n * (2 - 2t)) on twice that plus the partner's own misses.
 - If the set has more than `miss` tokens of class 0 and 1, its prefix is the first miss + 1 of them, each a signature.
   Tokens of class 0 are in no other set, so they count but need not be sent.
 - Else all of its r such tokens are signatures, and the prefix is extended by wide - 2r + 2 frequent tokens; each
   2-combination of neighbours among these is a signature (k is 2 for all frequent tokens). A token that only one side has
   breaks at most two of the other's combinations, so a linked pair shares a single token or a combination.
Two linked sets always share a signature: take the one whose prefix ends first; what the other shares of it lies in the
other's prefix too. The classes decide speed only, never results, so they may come from hashed counts: frequency counts
cover all tokens of all documents, and are kept as two bit tables of bounded size which every task reads. Where more tokens are
in over RARE sets than the frequent table can tell apart, the count from which a token is frequent doubles until they fit, so
that table never fills up. The other table may: then tokens of class 0 read as rare, and a set sends up to miss + 1 signatures.

Two sets that meet under a combination have no rare token in common, or they would meet under that one as well; so a posting
carries `most`, the tokens its set can have in common with a partner under that signature, and pairs that this bound (and the
length bound) rules out are not made.

Verification is exact on the hashed sets. Copies are not expanded to all pairs: under each signature every set is first
compared with the most central one (fewest rare tokens); after components of these links are known, only pairs under one
signature that are still in different components are compared, and of those only the ones whose parity sketches do not already
prove more differing tokens than the threshold allows. No candidate that could be linked is dropped at any step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Scratch, lean_batches, let_go, mix, word_chunks
from .components import components

#: A token in more sets than that is frequent (or in twice, four times, ... as many, see above).
RARE = 8
#: Most bits of the table of tokens in two sets or more, and of that of frequent tokens: 32 and 8 MiB, whatever the input.
#: Smaller inputs take 16 and 4 bits a token.
SHARED_BITS = 1 << 28
FREQUENT_BITS = 1 << 26
#: Bits for each frequent token, at least.
ROOM = 4
#: Tokens that one task counts before it sends them on, and that one counting group gets.
FLUSH = 1 << 20
RANGE = 1 << 20
_SET = np.uint64(0x94D049BB133111EB)
_FILTER_BITS = 1 << 26
#: Cells of a set's parity sketch: 64 bytes.
SKETCH = 512


def token_sets(column, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each text; of fewer than k words, all of them are one token; of none, no token."""
    for i, j, w in word_chunks(column, SPACE_WORDS):
        h, ok = w.shingles(k)
        first = w.first.tolist()
        for row in range(i, j):
            a, b = first[row - i], first[row - i + 1]
            if b - a >= k:
                yield row, np.unique(h[a : b - k + 1])
            elif b > a:
                acc = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for x in w.hash[a:b]:
                        acc = acc * np.uint64(0xBF58476D1CE4E5B9) + x
                    yield row, mix(np.array([acc ^ _SET]))
            else:
                yield row, np.empty(0, np.uint64)


def set_hash(tokens: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([mix(tokens ^ _SET).sum(dtype=np.uint64) + np.uint64(len(tokens))]))[0]


def _place(h: np.ndarray, n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Counting group and key within it."""
    return ((h >> np.uint64(32)) % np.uint64(n_ranges)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _bit(key: np.ndarray, size: int) -> np.ndarray:
    return (mix(key.astype(np.uint64)) % np.uint64(8 * size)).astype(np.int64)


def node_rows(docs: DataFrame, k: int, row=None) -> DataFrame:
    """doc_id, row (a long column of the caller's; else null), node (null for an empty set), n_shingles, for every row."""

    def run(batches):
        import pyarrow as pa

        let_go()
        for batch in batches:
            node, n = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for row, tokens in token_sets(batch.column(1), k):
                n[row] = len(tokens)
                if len(tokens):
                    node[row] = set_hash(tokens).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node, mask=n == 0), pa.array(n)], ["doc_id", "row", "node", "n_shingles"])

    row = (F.lit(None) if row is None else row).cast("long").alias("row")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row).mapInArrow(run, "doc_id long, row long, node long, n_shingles long")


def _sizes(total: int, n_ranges: int) -> tuple[int, int]:
    """Bytes of each bit table for each counting group."""
    return tuple(max(8, min(most, each * total) // (8 * n_ranges)) for most, each in ((SHARED_BITS, 16), (FREQUENT_BITS, 4)))


def _doc_bit():
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(_FILTER_BITS))


def _doc_table(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size (8 MiB) over the doc_ids of `ids`. Other ids may share a bit."""
    rows = ids.select(_doc_bit().alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    table = np.zeros(_FILTER_BITS // 64, np.int64)
    for batch in rows.toArrow().to_batches():  # at most 2 ** 20 rows, whatever the input
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table.view(np.uint64)


def _marked(table: np.ndarray, bits) -> np.ndarray:
    bit = bits.to_numpy()
    return (table[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1


def _counted(sets, n_ranges: int):
    """Token arrays -> record batches of counting groups: tokens seen once, tokens seen more often, and how often. Groups without
    a token here have no row, so there are never more rows than tokens."""
    import pyarrow as pa

    held, size = [], 0

    def flush():
        h, count = np.unique(np.concatenate(held), return_counts=True)
        group, key = _place(h, n_ranges)
        many = count > 1
        order = np.lexsort((many, group))
        group, key, count, many = group[order], key[order], count[order].astype(np.uint32), many[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        end = np.r_[first[1:], len(group)]
        split = end - np.add.reduceat(many.astype(np.int64), first)
        out = [(key[a:m].tobytes(), key[m:e].tobytes(), count[m:e].tobytes()) for a, m, e in zip(first.tolist(), split.tolist(), end.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(group[first], pa.int64()), *(pa.array(col, pa.binary()) for col in zip(*out))], ["part", "once", "more", "times"])

    for tokens in sets:
        held.append(tokens)
        size += len(tokens)
        if size >= FLUSH:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def count_tables(docs: DataFrame, copied: DataFrame, k: int, n_ranges: int, sizes: tuple[int, int], scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The bit tables of shared and of frequent tokens. Each is made of one segment a counting group.

    Every set counts once. copied: doc_id of documents whose set other documents have too; these (and the few that share a bit
    with one) are made distinct by set before they are counted, the others are counted where they are read.
    """
    marks = docs.sparkSession.sparkContext.broadcast(_doc_table(copied))

    def alone(batches):
        import pyarrow as pa

        def sets():
            for batch in batches:
                batch = batch.filter(pa.array(~_marked(marks.value, batch.column(1))))
                yield from (tokens for _, tokens in token_sets(batch.column(0), k) if len(tokens))

        yield from _counted(sets(), n_ranges)

    def copies(batches):
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(pa.array(_marked(marks.value, batch.column(1))))
            seen: dict[int, bytes] = {}
            for _, tokens in token_sets(batch.column(0), k):
                if len(tokens):
                    seen.setdefault(int(set_hash(tokens).view(np.int64)), tokens.tobytes())
            rows = list(seen.items())
            for i in range(0, len(rows), 1000):
                node, blob = zip(*rows[i : i + 1000])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(blob, pa.binary())], ["node", "tokens"])

    def pack(batches):
        yield from _counted((np.frombuffer(x.as_buffer(), np.uint64) for b in batches for x in b.column(0)), n_ranges)

    shared_size, frequent_size = sizes

    def counts_of(key, table):
        import pyarrow as pa

        once, more, times = [], [], []
        for b in table.to_batches():
            for x, y, z in zip(b.column("once").to_pylist(), b.column("more").to_pylist(), b.column("times").to_pylist()):
                once.append(np.frombuffer(x, np.uint32))
                more.append(np.frombuffer(y, np.uint32))
                times.append(np.frombuffer(z, np.uint32))
        ones = np.concatenate(once)
        x = np.concatenate([ones, *more])
        c = np.concatenate([np.ones(len(ones), np.int64), *times])
        order = np.argsort(x, kind="stable")
        x, c = x[order], c[order]
        at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        total = np.add.reduceat(c, at)
        x = x[at]
        often = total > RARE
        out = [_packed(x[total >= 2], shared_size), x[often].tobytes(), total[often].tobytes()]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in out)], ["part", "shared", "often", "times"])

    counts = "part long, once binary, more binary, times binary"
    read = docs.select(F.col("text").cast("string").alias("text"), _doc_bit().alias("bit"))
    once = read.mapInArrow(copies, "node long, tokens binary").groupBy("node").agg(F.any_value("tokens").alias("tokens"))
    sent = read.mapInArrow(alone, counts).unionByName(once.select("tokens").mapInArrow(pack, counts))
    counted = scratch.write(sent.groupBy("part").applyInArrow(counts_of, "part long, shared binary, often binary, times binary"))
    marks.destroy()
    least = _least_frequent(counted)

    def segments(batches):
        import pyarrow as pa

        for b in batches:
            bits = [_packed(np.frombuffer(x.as_buffer(), np.uint32)[np.frombuffer(c.as_buffer(), np.int64) > least], frequent_size) for x, c in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["part", "shared", "frequent"])

    shared, frequent = np.zeros(n_ranges * shared_size, np.uint8), np.zeros(n_ranges * frequent_size, np.uint8)
    for batch in counted.mapInArrow(segments, "part long, shared binary, frequent binary").toArrow().to_batches():  # 40 MiB at most
        for part, x, y in zip(*(batch.column(i) for i in range(3))):
            part = part.as_py()
            shared[part * shared_size : (part + 1) * shared_size] = np.frombuffer(x.as_buffer(), np.uint8)
            frequent[part * frequent_size : (part + 1) * frequent_size] = np.frombuffer(y.as_buffer(), np.uint8)
    scratch.drop(counted)
    return shared, frequent


def _packed(keys: np.ndarray, size: int) -> bytes:
    bits = np.zeros(8 * size, bool)
    bits[_bit(keys, size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _least_frequent(counted: DataFrame) -> int:
    """The count above which a token is frequent: RARE, doubled until such tokens have ROOM bits each in the largest table."""

    def levels(batches):
        import pyarrow as pa

        n = np.zeros(64, np.int64)
        for b in batches:
            for c in b.column(0):
                times = np.frombuffer(c.as_buffer(), np.int64)
                # level i: more than RARE * 2 ** i, and no more than twice that
                n += np.bincount(np.frexp((times - 1) // RARE)[1] - 1, minlength=64)[:64]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["level", "n"])

    n = {r.level: r.n for r in counted.select("times").mapInArrow(levels, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()}  # 64 rows at most
    level = 0
    while ROOM * sum(x for i, x in n.items() if i >= level) > FREQUENT_BITS:
        level += 1
    return RARE << level


def _test(table: np.ndarray, group: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    bit = _bit(key, size)
    return (table[group * size + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1


def signatures(tokens: np.ndarray, kind: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of sorted tokens with their classes, and for each how many of the tokens a partner under it can
    have: for a single token all but those of class 0, for a combination the frequent ones."""
    n = len(tokens)
    miss, wide = math.floor(n * (1 - t)), math.floor(n * (2 - 2 * t))
    alone, rare = int((kind == 0).sum()), tokens[kind == 1]
    r = alone + len(rare)
    if r > miss:
        rare = rare[: max(0, miss + 1 - alone)]
        return rare, np.full(len(rare), n - alone, np.int32)
    frequent = tokens[kind == 2][: wide - 2 * r + 2]
    with np.errstate(over="ignore"):
        pairs = mix(frequent[:-1] * np.uint64(0xBF58476D1CE4E5B9) + frequent[1:] + _SET)
    return np.concatenate([rare, pairs]), np.repeat(np.array([n - alone, n - r], np.int32), [len(rare), len(pairs)])


def postings(docs: DataFrame, k: int, t: Fraction, n_ranges: int, sizes: tuple[int, int], tables) -> DataFrame:
    """sig, node, n, most: the signatures of every set; of copies in one batch, one."""
    shared_size, frequent_size = sizes

    def run(batches):
        import pyarrow as pa

        shared, frequent = tables.value
        for batch in batches:
            sigs, who, size, most, seen = [], [], [], [], set()
            for _, tokens in token_sets(batch.column(0), k):
                if not len(tokens) or (s := int(set_hash(tokens))) in seen:
                    continue
                seen.add(s)
                group, key = _place(tokens, n_ranges)
                kind = _test(shared, group, key, shared_size).astype(np.int8)
                kind += kind * _test(frequent, group, key, frequent_size)
                sig, shareable = signatures(tokens, kind, t)
                if len(sig):
                    sigs.append(sig)
                    who.append(s)
                    size.append(len(tokens))
                    most.append(shareable)
            if sigs:
                reps = [len(x) for x in sigs]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(who, np.uint64).view(np.int64), reps)), pa.array(np.repeat(np.array(size, np.int32), reps)), pa.array(np.concatenate(most))], ["sig", "node", "n", "most"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "sig long, node long, n int, most int")


def _sets_of(docs: DataFrame, k: int, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """node, tokens (binary), sketch of the nodes in `wanted` (doc_id, node: one document of each; its doc_id may be null).

    sketch: the parity of the number of tokens in each of SKETCH hashed cells. Two sets differ in at least as many tokens as
    their sketches differ in bits.

    A bit table of fixed size (8 MiB) over the wanted doc_ids spares the others the work; the semi join is exact.
    """
    held = scratch.spark.sparkContext.broadcast(_doc_table(wanted))

    def run(batches):
        import pyarrow as pa

        names, types = ["doc_id", "node", "tokens", "sketch"], [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        table = held.value
        for batch in batches:
            keep = np.flatnonzero(_marked(table, batch.column(2)))
            if not len(keep):
                continue
            batch = batch.take(pa.array(keep))
            ids = batch.column(0).to_pylist()
            out, size = [], 0
            for row, tokens in token_sets(batch.column(1), k):
                if len(tokens):
                    parity = np.bincount((tokens & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
                    out.append((ids[row], int(set_hash(tokens).view(np.int64)), tokens.tobytes(), np.packbits(parity.astype(bool)).view(np.int64)))
                    size += tokens.nbytes
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _doc_bit().alias("bit")).mapInArrow(run, "doc_id long, node long, tokens binary, sketch array<long>")
    exact = made["doc_id"].eqNullSafe(wanted["doc_id"]) & (made["node"] == wanted["node"])
    out = scratch.write(made.join(wanted, exact, "left_semi").select("node", "tokens", "sketch").dropDuplicates(["node"]))
    held.destroy()
    return out


def _linked(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (u, v) of nodes whose sets reach the threshold."""
    num, den = t.numerator, t.denominator

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                if den * both >= num * (len(x) + len(y) - both):
                    keep.append(i)
            if keep:
                yield b.take(pa.array(keep)).select(["u", "v"])

    held = pairs.join(sets.select(F.col("node").alias("u"), F.col("tokens").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("y")), "v")
    return held.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _fits(n: str, m: str, most_n: str, most_m: str, t: Fraction):
    """Sets of n and m tokens of which so many can be in common can reach the threshold."""
    n, m, most = F.col(n).cast("long"), F.col(m).cast("long"), F.least(most_n, most_m).cast("long")
    return most * (t.numerator + t.denominator) >= (n + m) * t.numerator


def _band(n: str, t: Fraction):
    """Sets whose lengths can reach the threshold are in one band or in neighbouring ones (bands are a little wider than needed)."""
    return F.floor(F.log(n) / (1.0001 * math.log(1 / t))).cast("int") if t < 1 else F.col(n)


def jaccard_components(docs: DataFrame, k: int = 5, threshold: float | str = "0.8") -> DataFrame:
    """One row for each row of `docs` (doc_id, text; others are ignored): doc_id, n_shingles, component_id.

    component_id is the least doc_id reachable over links, itself included. A null or empty text, or one of blanks alone,
    has n_shingles 0, links with nothing and is its own component. A null doc_id is ordered last: it never names a
    component that has another id, but its text links like any other. Rows that repeat a doc_id are rows of their own, each with
    its text's component. Whole texts count, however long. An empty table gives an empty table.
    """
    return linked_rows(docs, k, threshold).select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, k: int = 5, threshold: float | str = "0.8", row=None) -> DataFrame:
    """`jaccard_components` with two more columns: row, a long column of the caller's over `docs` (else null), and root, one number
    for each component (null for an empty set)."""
    spark: SparkSession = docs.sparkSession
    t = Fraction(str(threshold))
    lean_batches(spark)
    scratch = Scratch(spark)
    rows = scratch.write(node_rows(docs, k, row))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    nodes = scratch.write(nodes)
    copied = rows.join(nodes.where("rows > 1").select("node"), "node", "left_semi").select("doc_id")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    n_ranges = max(1, math.ceil(total / RANGE))
    sizes = _sizes(total, n_ranges)
    if not total:
        return rows.select("doc_id", "row", "n_shingles", F.col("node").alias("root"), F.col("doc_id").alias("component_id"))

    tables = spark.sparkContext.broadcast(count_tables(docs, copied, k, n_ranges, sizes, scratch))
    sent = scratch.write(postings(docs, k, t, n_ranges, sizes, tables))
    tables.destroy()
    central = F.struct((F.col("n") - F.col("most")).alias("rare"), F.col("node").alias("node"), F.col("n").alias("n"), F.col("most").alias("most"))
    lead = sent.groupBy("sig").agg(F.min(central).alias("lead"), F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("sig", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.most").alias("lead_most"))
    shared = scratch.write(sent.join(lead, "sig").select("sig", "node", "n", "most", "lead", "lead_n", "lead_most").distinct())
    scratch.drop(sent)

    def as_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()

    near = shared.where((F.col("node") != F.col("lead")) & _fits("n", "lead_n", "most", "lead_most", t))
    pairs = scratch.write(as_pairs(near, "node", "lead"))
    wanted = scratch.write(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("doc_id", "node"))
    sets = _sets_of(docs, k, wanted, scratch)
    links = scratch.write(_linked(pairs, sets, t))
    root = components(scratch, links)

    def rooted(df: DataFrame, by: str = "node") -> DataFrame:
        return df.join(root.select(F.col("node").alias(by), "root"), by, "left").withColumn("root", F.coalesce("root", by))

    # what stars have not settled: pairs under one signature that are still in different components
    left = rooted(shared.select("sig", "node", "n", "most"))
    mixed = left.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("sig")
    left = scratch.write(left.join(mixed, "sig", "left_semi").join(sets.select("node", "sketch"), "node").withColumn("band", _band("n", t)))
    other = left.select("sig", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("most").alias("most2"), F.col("root").alias("root2"), F.col("sketch").alias("sketch2"), F.col("band").alias("band2"), F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    apart = F.expr(" + ".join(f"bit_count(sketch[{i}] ^ sketch2[{i}])" for i in range(SKETCH // 64)))
    near_enough = apart * (t.denominator + t.numerator) <= (F.col("n") + F.col("n2")).cast("long") * (t.denominator - t.numerator)
    once = (F.col("band") != F.col("band2")) | (F.col("node") < F.col("node2"))
    cross = left.join(other, ["sig", "band"]).where(once & (F.col("root") != F.col("root2")) & _fits("n", "n2", "most", "most2", t) & near_enough)
    rest = scratch.write(as_pairs(cross, "node", "node2").join(pairs, ["u", "v"], "left_anti"))
    more = scratch.write(_linked(rest, sets, t))
    if not more.isEmpty():
        root = components(scratch, links.unionByName(more))
    named = rooted(nodes.select("node", "doc_id"))
    low = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    where = scratch.write(named.select("node", "root").join(low, "root").select("node", "root", "component_id"))
    scratch.drop(shared, pairs, wanted, sets, links, left, rest, more, nodes)
    return rows.join(where, "node", "left").select("doc_id", "row", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))
