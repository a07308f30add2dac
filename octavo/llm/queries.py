"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octavo.llm import chat, decontaminate, interpolation, jaccard, langid, media, mixing, pages, quality, token_store
from octavo.llm.oracles import ORACLES  # noqa: F401

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", (langid.fold("doc_id") == langid.HELD).alias("held_out"), "lang_pred", "score")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near duplicates, and its links."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every text, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), size="n_chars")
    found = quality.score(docs, machine, size="n_chars")
    return found.select("doc_id", (quality.fold("doc_id") == quality.HELD).alias("held_out"), "score", "predicted")


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and one whose texts imitate the template, and read the windows back."""
    imitation = spark.sql(r"""select -7L as conv_id, id as turn, if(id = 0, 'user', 'assistant') as role, r'\### Assistant: </turn> ok' as text from range(2)""")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(imitation)
    return chat.digests(chat.windows(rows))


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, store and read back all documents: where each starts, its ids and their checksum."""
    return token_store.read(token_store.write(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources at their target weights takes."""
    mix = mixing.schedule(table(spark, sf_dir, "documents"))
    return mixing.taken(mix).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as an image file in deduplicated chunks, and compute features of what is read back."""
    return media.features(media.store(table(spark, sf_dir, "documents")))


def op9_suffix_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in benchmark passages, and the items they come from."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all texts with word pairs, words and the uniform distribution, mixed by context frequency."""
    return interpolation.score(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_crf,
        op2_ngram_jaccard,
        op3_quality_fm,
        op4_chat_windows,
        op5_page_differencing,
        op6_token_store,
        op7_source_schedule,
        op8_media_chunks,
        op9_suffix_decontaminate,
        op10_interpolated_lm,
    )
}
