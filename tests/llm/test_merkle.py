"""op13: against a plain tree in Python and against the query's SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The root, and of each leaf its siblings level by level as (left, right)."""
    at, path = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for p, i in zip(path, at):
            begin = i - i % 16
            p.append((nodes[begin:i], nodes[i + 1 : begin + 16]))
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], path


def brute(rows):
    leaf = lambda r: H(*map(coded, r))
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for rs in sources.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    low = {s: tree([leaf(r) for r in sources[s]]) for s in names}
    root, high = tree([low[s][0] for s in names])
    out = []
    for s, above in zip(names, high):
        for r, path in zip(sources[s], low[s][1]):
            path = path + above
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if changed else r[4]
            node = leaf((*r[:4], text))
            for left, right in path:
                node = H(*left, node, *right)
            out.append((r[0], leaf(r), low[s][0], root, H(*(x for left, right in path for x in left + right)), node, node == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows(n, sources, seed=1):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    out = [(pick(None, i, i, i, 7), pick(*sources), pick("en", None), pick(None, i), pick(None, "", "Some Text", "lower", "Ünï " + "X" * (i % 50))) for i in range(n)]
    return out + out[:3]


def spark_rows(spark, data):
    from genoflux.llm import op13

    path = data
    return sorted((tuple(r) for r in op13.op13_merkle(spark, path).collect()), key=repr)


def same(got, want):
    """Rows that are equal in every column have places of their own, so a row's proof is held against all of its equals'."""
    return sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("n, sources", [(0, ["a"]), (1, ["a"]), (16, ["a", "b"]), (17, [None]), (700, ["a", "hot", "hot", "hot", None, "é", "Z", ""]), (600, [f"s{i}" for i in range(300)])])
def test_manifest_against_a_plain_tree(spark, tmp_path, n, sources):
    data = rows(n, sources) if n > 1 else [(5, "a", "en", 3, "Abc")] * n
    df = spark.createDataFrame(data, SCHEMA)
    df.selectExpr("*", "'x' as digest", "1 as pos", "2 as g").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert same(spark_rows(spark, str(tmp_path)), brute(data) if data else [])


@pytest.mark.parametrize("shape", ["made", "shipped"])
def test_query_against_sql(spark, tmp_path, shape):
    from genoflux.llm import op13

    folder = "/root/testdata/sf0.001"
    if shape == "made":
        folder = str(tmp_path)
        spark.createDataFrame(rows(300, ["a", "b", "b", None]), SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{'/*.parquet' if shape == 'made' else ''}')")
    want = con.execute(op13.SQL).fetchall()
    assert same(spark_rows(spark, folder), want) and len(want) > 100
    assert 0 < sum(not r[-1] for r in want) < len(want)


def test_a_leaf_out_of_place_is_not_verified(spark):
    from pyspark.sql import functions as F

    from genoflux.llm.merkle import manifest

    docs = spark.createDataFrame(rows(200, ["a", "b"]), SCHEMA)
    assert manifest(docs).where("not verified").count() == 0
    got = manifest(docs, F.when(F.col("doc_id") == 7, "forged").otherwise(F.col("text"))).groupBy((F.col("doc_id") == 7).alias("seven")).agg(F.count_if("verified").alias("n")).collect()
    assert {r.seven: r.n for r in got}[True] == 0


def test_no_window_holds_more_than_a_run(spark):
    """Leaves are numbered by parts of a range, also where all rows are equal."""
    from genoflux.llm.common import Scratch
    from genoflux.llm.merkle import numbered

    equal = spark.range(5000, numPartitions=4).selectExpr("cast(null as long) as doc_id", "'s' as source", "'x' as digest")
    got = numbered(Scratch(spark), equal, "source", ["source", "doc_id", "digest"])
    assert sorted(r.pos for r in got.select("pos").collect()) == list(range(5000)) and got.select("n").distinct().collect()[0].n == 5000
