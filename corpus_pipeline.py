"""From raw documents to a training mixture: five stages over the operators of ``riskloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last adds
each row's place in the mixture and lays the rows out in that order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, langid, mixing, nearcopies, quality
from riskloom.llm.common import cut, table

#: A language is rejected as unknown below this probability, with or without letters.
LEAST_LANGUAGE_SCORE = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the importance weights accept; the labels of the corpus give the target.

    Null, empty and wordless texts are rejected. Texts of any length are weighed whole. Repeated rows stay or go together;
    no labels reject all, an empty table gives no rows. Other columns are kept, whatever their names.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.weigh(docs, model).filter("accepted").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a language that the network knows, and hand the language found on as ``lang``.

    Null texts, texts without a letter and those under LEAST_LANGUAGE_SCORE are rejected, and all texts if no row has a
    language to learn from. Of equally likely languages the first by name is taken. Repeated rows stay or go together; an
    empty table gives no rows. A column named lang_pred or score is kept as it is.
    """
    net = langid.fit(docs)
    marked = langid.identify(docs.select(F.struct("*").alias("row"), "text"), net).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return marked.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id: SimHash links and similar shingle sets.

    Of equal ids a hash of id and text decides, a null id comes last, and of rows alike in both one stays. Null, empty and
    wordless texts are one group. Texts of any length are read whole; an empty table gives no rows. Other columns are kept.
    """
    return nearcopies.drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts of which a twentieth or more stands in the benchmark.

    Null and wordless texts stay, as they hold nothing of it; null and wordless items match nothing. Texts of any length are
    searched whole. Repeated rows stay or go together; an empty benchmark drops none. Other columns are kept.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Interleave the sources by weight; every row stays and gets its position.

    A null source is the source ''. Texts are not read. Equal ids are ordered by a hash of all columns, and repeated rows have
    a place each; an empty table gives no rows. Columns named mix_phase, mix_block or mix_position are replaced.
    """
    return mixing.mixed_in_order(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixture),
]

#: Trained models and hashes have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is stored in the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
