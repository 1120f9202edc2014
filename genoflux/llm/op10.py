"""Query op10_sentencepiece."""

import public_tokenizers

from .common import read
from .sentencepiece_codec import round_trip_digests


def op10_sentencepiece(spark, sf_dir):
    return round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
