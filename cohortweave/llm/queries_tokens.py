"""Query of the cross-tokenizer alignment. Token ids have no SQL form; tests compare it with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortweave.llm import alignment
from cohortweave.llm.registry import query, table


@query("op13_alignment")
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    return alignment.align_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.path("piece_bpe_32k.model"))
