"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, token output.

Every stage takes and returns whole documents (the last one: where each document's tokens lie), and is
written as Parquet and read again before the next. A stage begins by giving back the heap that the one before has grown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from octavo.llm import decontaminate, jaccard, langid, mixing, token_store
from octavo.llm.queries import table, tokenizer_path
from octavo.llm.shared import give_back, keep, remove, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined: at least 0.4 of the mean posterior over their words speaks for one language.

    Null texts, texts without a letter and a corpus without any label leave nothing determined, so these rows go.
    Repeated rows are judged each; ties between languages go to the first by name. An empty table stays empty.
    """
    give_back(spark)
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five words, 0.8): the one with the smallest id, null ids last.

    Of rows with one id and one text, one stays. Null texts and texts without words are no duplicates of anything.
    An empty table stays empty.
    """
    give_back(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null texts have no words and stay. Items with a null id count, items without words don't. Repeated rows go or stay
    together. An empty table of documents or of items changes nothing.
    """
    give_back(spark)
    return decontaminate.remove_affected(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (not at all, once or twice) as the mix takes at least half of them.

    Documents without words (null texts too) are in no mix. A null source is a source. Rows that tie in id and hash are
    taken together. An empty table stays empty.
    """
    give_back(spark)
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the content-addressed store, read back: doc_id, start, n_tokens, ids_crc32.

    Null texts have the end id alone; null ids come first. Repeated rows are documents of their own that share their
    chunks. An empty table stays empty.
    """
    give_back(spark)
    return token_store.read(token_store.write(docs, tokenizer_path()))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID output", token_ids),
]

#: A model's decisions are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote on the way goes when its result is written, and that after the next stage."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", outer=True)
        if before is not None:
            remove(spark, before)
        before = docs.inputFiles()[0].rpartition("/")[0] if docs.inputFiles() else None
    return STAGES[-1][1](spark, docs, sf_dir)
