"""Query op12_alignment."""

import public_tokenizers

from .alignment import linked_scores
from .common import read


def op12_alignment(spark, sf_dir):
    return linked_scores(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
