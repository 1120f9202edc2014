"""Query op5_language_id."""

from .common import read
from .language_id import identified


def op5_language_id(spark, sf_dir):
    return identified(read(spark, sf_dir, "documents"))
