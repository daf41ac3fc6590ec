"""From raw documents to packed training sequences, in stages over DataFrames.

Each stage takes the documents that the one before kept, all of them, and all but the last
return the columns of documents. Stages keep extra columns, null ids and repeated rows as their
operators define it, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorview.llm import decontaminate, language, lines, packing, simhash
from priorview.llm.common import stored, table

LEAST_SCORE = 0.3   # of a language; four equal ones would have 0.25 each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) or of no recognised language.
    A table without labels rejects nothing but the former."""
    model = language.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.accepted(docs, model, least=LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of all documents but the first that holds them. No document is
    dropped; n_chars follows the text."""
    out = lines.dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near duplicates (four-word shingles,
    four differing bits). Documents without words are one group."""
    return simhash.without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    from public_tokenizers import path

    out = packing.packed_documents(docs, path("word_bpe_49k.json"))
    return out.withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32"})


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("best_fit_packing", best_fit_packing)]

#: Trained language models and sampled masks have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
