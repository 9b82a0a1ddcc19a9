"""SentencePiece encoding and decoding: the registered query."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sentencepiece
from .registry import query, table

MODEL = "piece_bpe_32k.model"


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole document, and whether they decode to the text again."""
    path = public_tokenizers.path(MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece.encode(docs, path, again="decoded")
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepiece.SPACE), F.lit(" "))
    return both.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.size("pieces").cast("bigint").alias("n_pieces"),
                       F.xxhash64("pieces").alias("pieces_hash"), F.crc32("decoded").alias("decoded_crc32"),
                       (F.col("decoded") == plain).alias("exact"))
