"""Readers and writers of site tables, pair tables and small side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def unpivoted(wide: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Wide site by sample table -> one row for each site and sample."""
    samples = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, samples, name, value)


def decoded(df: DataFrame) -> DataFrame:
    """Binary columns as UTF-8 text."""
    return df.select(*(F.decode(F.col(c), "UTF-8").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes))


def read_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pair tables, one CSV file a species; dot files and *mut_opportunity.csv are left out; header-only files give no row."""
    return spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path).where(~F.input_file_name().rlike(r"/(\.[^/]*|[^/]*mut_opportunity\.csv)$"))


def as_clonal(df: DataFrame) -> DataFrame:
    """Pairs without recombination: their core columns are their clonal columns."""
    return df.withColumns({f"clonal_{k}": F.col(f"core_{k}") for k in ("len_1d", "len_4d", "diff_1d", "diff_4d")})


def all_pairs(close: DataFrame, clonal: DataFrame, blacklist: list[str]) -> DataFrame:
    """Close and clonal pairs in one table with pair_class; recombination columns of clonal pairs are null."""
    both = close.withColumn("pair_class", F.lit("close")).unionByName(as_clonal(clonal).withColumn("pair_class", F.lit("clonal")), allowMissingColumns=True)
    return listed(both, blacklist)


def listed(df: DataFrame, blacklist: list[str], species: str = "species_name") -> DataFrame:
    """Without blacklisted species."""
    return df.where(~F.col(species).isin(blacklist)) if blacklist else df


def read_clades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CLADES).option("sep", "\t").csv(path)


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GENES).option("sep", "\t").csv(path)


def read_matrix(spark: SparkSession, path: str, sample_index: DataFrame, sep: str = ",") -> DataFrame:
    """Headerless square matrix (one file, rows in order) -> sample_a, sample_b, frac. sample_index: position, sample_id."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("i", "line"))
    cells = lines.select("i", F.posexplode(F.split("line", sep)).alias("j", "frac"))
    a, b = (sample_index.select(F.col("position").alias(p), F.col("sample_id").alias(n)) for p, n in (("i", "sample_a"), ("j", "sample_b")))
    return cells.join(a, "i").join(b, "j").select("sample_a", "sample_b", F.col("frac").cast("double").alias("frac"))


def write_matrices(similarity: DataFrame, sample_index: DataFrame, writer) -> None:
    """One folder a species, one line a row of its matrix: the row's position, a tab, and the cells. `writer` takes the lines.

    similarity: species, sample_a, sample_b, frac, a row a pair at most; sample_index: species, position, sample_id. Lines are as long as a
    species has samples, but rows made are those of `similarity`."""
    a, b = (sample_index.select("species", F.col("sample_id").alias(n), F.col("position").alias(p)) for n, p in (("sample_a", "i"), ("sample_b", "j")))
    cells = similarity.where("frac is not null").join(a, ["species", "sample_a"]).join(b, ["species", "sample_b"])
    cell = F.struct("j", F.col("frac").cast("string").alias("v"))
    cells = cells.groupBy("species", "i").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    n = sample_index.groupBy("species").agg(F.count("*").cast("int").alias("n"))  # a row a species
    rows = a.select("species", "i").join(F.broadcast(n), "species").join(cells, ["species", "i"], "left")
    # commas up to a cell and its value; no row is made for an empty cell
    steps = F.expr("transform(cells, (x, k) -> concat(repeat(',', cast(x.j - coalesce(get(cells, k - 1).j, 0) as int)), x.v))")
    line = F.concat(F.array_join(F.coalesce(steps, F.expr("cast(array() as array<string>)")), ""), F.expr("repeat(',', cast(n - 1 - coalesce(get(cells, size(cells) - 1).j, 0) as int))"))
    writer(rows.select("species", F.concat_ws("\t", F.col("i").cast("string"), line).alias("value")))


def read_matrices(spark: SparkSession, path: str, sample_index: DataFrame, sep: str = ",", empty: bool = True) -> DataFrame:
    """What write_matrices wrote -> species, sample_a, sample_b, frac; a row at a time, empty cells as null, or left out before they meet their
    samples."""
    lines = spark.read.schema("value string, species string").text(path)
    cells = lines.select("species", F.split("value", "\t")[0].cast("int").alias("i"), F.posexplode(F.split(F.split("value", "\t")[1], sep)).alias("j", "frac"))
    cells = cells if empty else cells.where("frac != ''")
    a, b = (sample_index.select("species", F.col("position").alias(p), F.col("sample_id").alias(n)) for p, n in (("i", "sample_a"), ("j", "sample_b")))
    return cells.join(a, ["species", "i"]).join(b, ["species", "j"]).select("species", "sample_a", "sample_b", F.when(F.col("frac") != "", F.col("frac")).cast("double").alias("frac"))


def named_pairs(close_pairs: DataFrame, sample_index: DataFrame) -> DataFrame:
    """Pairs of sample positions (species, i, j) -> sample ids."""
    a, b = (sample_index.select("species", F.col("position").alias(p), F.col("sample_id").alias(n)) for p, n in (("i", "sample_1"), ("j", "sample_2")))
    return close_pairs.join(a, ["species", "i"]).join(b, ["species", "j"]).select("species", "sample_1", "sample_2")


def unfinished(work: DataFrame, done: DataFrame, key: str = "species") -> DataFrame:
    """Rows of species that have no result yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


MANIFEST = "_finished"  # readers of the table pass over names that begin with an underscore


def write_by_species(df: DataFrame, path: str, key: str = "species") -> None:
    """One folder a species; only the species in `df` are replaced. When all are in place, their names are added to the manifest, so a
    run that ends early leaves none of them finished."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    df.select(key).distinct().write.mode("append").parquet(f"{path}/{MANIFEST}")


def finished(spark: SparkSession, path: str, key: str = "species", kind: str = "string") -> DataFrame:
    """The species of the table at `path` that were written to their end; none where there is no table yet."""
    if not _exists(spark, f"{path}/{MANIFEST}/_SUCCESS"):
        return spark.createDataFrame([], f"{key} {kind}")
    return spark.read.schema(f"{key} {kind}").parquet(f"{path}/{MANIFEST}").distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached_table(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at `path`, written by make() where no write of it has come to its end (Spark's _SUCCESS file tells); what a write that
    failed left there is replaced."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def species_of_file(path: Column) -> Column:
    """Species name of a per-species file."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
