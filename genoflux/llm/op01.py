"""Query op1_secret_scan."""

from .common import read
from .secret_scan import findings


def op1_secret_scan(spark, sf_dir):
    return findings(read(spark, sf_dir, "documents"))
