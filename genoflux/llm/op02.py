"""Query op2_kk_sharding: documents in shards 0 to 23, by bytes."""

from pyspark.sql import functions as F

from .common import read
from .kk_shards import sharded


def op2_kk_sharding(spark, sf_dir):
    df = sharded(read(spark, sf_dir, "documents"), 24)
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
