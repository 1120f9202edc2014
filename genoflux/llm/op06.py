"""Query op6_token_counts."""

import public_tokenizers

from .common import read
from .token_counts import token_counts


def op6_token_counts(spark, sf_dir):
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)
