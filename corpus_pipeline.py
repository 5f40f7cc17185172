"""A corpus pipeline over ``documents``: language, near duplicates, source mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and is written as Parquet
before the next one reads it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import bpe, langid, minhash, mixing
from panelwright.llm.base import Scratch, join_measured, small_batches
from panelwright.llm.queries import VOCABULARY

#: The score of a document that shares no n-gram with any language's profile, whatever its script and length.
MIN_SCORE = 0.0
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _scripts(spark: SparkSession, profiles: langid.Profiles) -> list[str]:
    """The Unicode scripts of the letters in the profiles' n-grams."""
    codes = profiles.codes[profiles.codes > 0]
    letters = {int(c) - 1 for k in range(langid.ORDERS) for c in np.unique(codes >> (langid._BITS * k) & ((1 << langid._BITS) - 1)) if c > 1}  # noqa: SLF001
    script = getattr(spark.sparkContext._jvm.java.lang, "Character$UnicodeScript")  # noqa: SLF001
    return sorted({script.of(c).name() for c in letters} - {"COMMON", "INHERITED", "UNKNOWN"})


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be recognised: operator 10 answers ``und``, or no n-gram is in any profile and no letter of a script of theirs.

    A short text of rare characters can miss the profile of its large script, so its script is asked as well.

    Null and empty texts and those without letters go. Rows that repeat an id or a text are judged each, a null
    id, lang or source does not matter, and other columns than those of documents are left behind. With nothing
    to learn from every document is ``und`` and goes; an empty table stays empty.
    """
    small_batches(spark)
    profiles = langid.fit(docs.where(~langid.held_out()))
    known = F.col("score") > MIN_SCORE
    if scripts := _scripts(spark, profiles):
        known |= F.col("text").cast("string").rlike("[" + "".join(f"\\p{{script={x}}}" for x in scripts) + "]")
    return langid.predict(docs.select(*COLUMNS), profiles, keep=COLUMNS).where((F.col("lang_pred") != "und") & known).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (operator 7).

    Of kept rows that repeat both id and text (a null id counts as one) the one with the least lang, source
    and n_chars stays; other texts of a repeated id stay each. Operator 7 links no null id to other documents.
    Null, empty and blank texts are linked with nothing and stay, once per id; very long ones are compared whole;
    an empty table stays empty.
    """
    small_batches(spark)
    scratch = Scratch(spark)
    classes = minhash.near_duplicates(docs)
    gone = scratch.save(classes.where("not kept").select("doc_id").distinct(), "gone")
    left = join_measured(docs.select(*COLUMNS), gone, "doc_id", "left_anti", gone.count())
    often = scratch.save(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "often")
    n = often.count()
    if not n:
        return left
    # only rows of repeated ids are shuffled by their texts
    same = left["doc_id"].eqNullSafe(often["doc_id"])
    once = join_measured(left, often, same, "left_anti", n)
    least = F.min(F.struct("lang", "source", "n_chars")).alias("least")
    copies = join_measured(left, often, same, "left_semi", n).groupBy("doc_id", "text").agg(least).select("doc_id", "text", "least.*")
    return once.union(copies.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources reach their target weights (operator 5).

    Documents without a source are a source of their own; repeated rows get equal numbers of copies; nulls in
    other columns do not matter; an empty table stays empty.
    """
    return mixing.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (operator 8).

    Null and empty texts have no tokens, very long ones are encoded whole, repeated rows each; an empty table
    stays empty.
    """
    small_batches(spark)
    return bpe.encode(docs, VOCABULARY, keep=("doc_id", "lang", "source")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("mix", mix), ("tokenise", tokenise)]
#: BPE and language profiles can't be said in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
