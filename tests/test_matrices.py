"""Similarity matrices of all species through text files."""

import duckdb
import pytest
from test_queries import SF, TABLES, same

from genoflux.plans import registry
from genoflux.sources import tables as T


@pytest.mark.parametrize("name", ["s9_similarity_matrices", "s9_similarity_matrix"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = sorted(map(tuple, registry.QUERIES[name](spark, SF).select(*names).collect()))
    right = sorted(want.fetchall())
    assert len(got) == len(right) > 0 and all(same(x, y) for a, b in zip(got, right) for x, y in zip(a, b))
    assert "species" not in names or len({r[0] for r in got}) == 5


def test_a_line_holds_one_row(spark, tmp_path):
    sim = spark.createDataFrame([("a b", 7, 7, 1.0), ("a b", 7, 9, 0.25), ("c", 1, 1, 1.0)], "species string, sample_a long, sample_b long, frac double")
    index = spark.createDataFrame([("a b", 7, 0), ("a b", 9, 1), ("c", 1, 0)], "species string, sample_id long, position int")
    d = str(tmp_path / "m")
    T.write_matrices(sim, index, lambda rows: rows.write.partitionBy("species").text(d))
    assert sorted(tuple(r) for r in spark.read.text(d).select("value", "species").collect()) == [("0\t1.0", "c"), ("0\t1.0,0.25", "a b"), ("1\t,", "a b")]
    got = T.read_matrices(spark, d, index)
    assert got.count() == 5 and sorted(tuple(r) for r in got.where("frac is not null").collect()) == [("a b", 7, 7, 1.0), ("a b", 7, 9, 0.25), ("c", 1, 1, 1.0)]


def test_no_row_is_made_for_an_empty_cell(spark, tmp_path):
    index = spark.createDataFrame([("A", i, i * 10) for i in range(300)] + [("B", 0, 7)], "species string, position int, sample_id long")
    similarity = spark.createDataFrame([("A", 20, 2990, 0.25), ("A", 20, 0, 1.0), ("A", 2990, 2990, 0.5), ("B", 7, 7, 1.0)], "species string, sample_a long, sample_b long, frac double")
    T.write_matrices(similarity, index, lambda rows: rows.write.partitionBy("species").text(str(tmp_path / "m")))
    lines = {r.value for r in spark.read.text(str(tmp_path / "m")).where("species = 'A'").collect()}
    assert "2\t1.0" + "," * 299 + "0.25" in lines and "3\t" + "," * 299 in lines and "299\t" + "," * 299 + "0.5" in lines and len(lines) == 300
    got = T.read_matrices(spark, str(tmp_path / "m"), index, empty=False)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, similarity.collect()))
    assert T.read_matrices(spark, str(tmp_path / "m"), index).count() == 300 * 300 + 1
