"""The corpus pipeline: stages over `documents`, each written and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import drop_materialised, materialise, table, tables_of_run
from barwright.llm.learn import fold
from barwright.llm.mixing import mix
from barwright.llm.packing import pack
from barwright.llm.quality import fit_quality, quality_filter
from barwright.llm.queries import TREE_WEIGHTS, tree
from barwright.llm.shingles import one_of_each_similar
from barwright.llm.suffixes import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier, fitted on the labelled ones, gives a score of 0.3 or more.

    Null ids and repeated rows are scored like any row; a null or empty text is one empty passage.
    """
    return quality_filter(docs, fit_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group whose sets of five-word shingles have a similarity of 0.8 or more.

    Texts without words are one group; rows with a null id stay; rows that share an id stay or go together.
    """
    return one_of_each_similar(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any 100 bytes that an earlier document, or the same one earlier, has too.

    Null ids come first; rows that repeat id and text are one document, each with its result; a null text becomes "".
    """
    out = remove_repeats(docs, carry=["lang", "source"], whole_characters=True)
    text = F.col("kept").cast("string")
    return out.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the token budgets of the domain-language-source tree, each at most once.

    Rows with a null id, or that repeat one, are taken together or not at all; a text without words has no tokens and goes by its place in its leaf's order.
    """
    return mix(docs, tree(), TREE_WEIGHTS, budget_share=0.9, max_epochs=1).drop("epoch")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 ids, filled to the sources' token shares.

    Every row is packed, an empty text as its end id alone; a null source is a queue like any other.
    """
    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "padded_length")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. Once a stage's result is written, what it was made from is deleted; tables of other runs stay, also of those in other threads.

    In every stage a null text is an empty one, texts of any length are read whole, rows that repeat an id are rows of their
    own unless the stage says otherwise, columns besides those of documents are left out, and an empty table stays empty.
    """
    with tables_of_run():
        docs = table(spark, sf_dir, "documents")
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = materialise(docs, f"pipeline-{name}")
                drop_materialised(spark, keep=1)
        return docs
