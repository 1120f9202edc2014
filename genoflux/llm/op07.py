"""Query op7_html_extraction."""

from .common import read
from .html_crf import extracted


def op7_html_extraction(spark, sf_dir):
    return extracted(read(spark, sf_dir, "pages"))
