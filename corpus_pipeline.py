"""The corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

Each stage takes what the stage before it kept. The first three return rows of documents with all their columns. The first
two judge each row by itself, with or without an id, and carry it through. Of near copies one row stays: the one of the
smallest doc_id, of rows that are alike in id and text one. A row without an id goes if it links with one that has an id,
and one of rows without an id that are alike in text stays. Null, empty and blank texts fail the quality rules; very long
ones are judged whole. Extra columns stay as they are. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import stored, table
from panelspark.llm.jaccard_join import jaccard_components
from panelspark.llm.language_id import UNKNOWN, identify, learn
from panelspark.llm.packing import pack
from panelspark.llm.quality_rules import log_ratios, quality_rules, trusted_ids


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole_row"))


#: Score below which a document's language counts as unknown.
LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents go whose texts fail the base rules or whose likelihood ratio is low."""
    ratios = log_ratios(docs, trusted_ids(table(spark, sf_dir, "labels")))
    return quality_rules(_whole(docs), ratios, carry=("whole_row",)).where("kept").select("whole_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents go whose language is unknown, by lack of letters or by score. Without a labelled row no
    language can be learned, and all stay."""
    net = learn(docs)
    if net is None:
        return docs
    return identify(_whole(docs), net, carry=("whole_row",)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("whole_row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of linked documents, whose texts are near copies, the one of smallest doc_id stays."""
    key = {"row_id": F.coalesce("doc_id", F.lit(0)), "row_null": F.col("doc_id").isNull()}
    found = jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumns(key)
    found = stored(found.select(*key, F.col("mark").alias("row_mark")).distinct(), "kept")
    left = docs.select(*(v.alias(k) for k, v in key.items()), F.xxhash64("text").alias("row_mark"), F.struct(*docs.columns).alias("whole_row"))
    return left.join(found, found.columns, "left_semi").dropDuplicates(found.columns).select("whole_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of packed sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("language", language), ("deduplicate", deduplicate), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
