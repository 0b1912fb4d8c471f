"""Columns that bear the operators' inner names change nothing."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from riskloom.llm import classlm, langid, multiset, quality, simhash, tokencounts, toxicity
from riskloom.llm.common import id_remainder, table

NAMES = ["key", "fp", "row", "h", "c", "n", "k", "t", "l", "y", "label", "root", "node", "src", "dst", "bucket", "nr", "halo", "edited", "lanes", "start", "end", "section", "n_words", "held_out", "base", "item_id", "items", "spans", "u", "v", "w", "kind", "quality", "toxic", "first", "least", "s", "hash", "tie", "blocks", "rank", "noise", "place", "gumbel_key_", "__hash", "__row", "__key", "_row", "_key"]


@pytest.fixture(scope="module")
def both(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("doc_id < 60")
    return docs, docs.select("*", *[F.lit(None).cast("int").alias(n) for n in NAMES])


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, sf_dir, both, k):
    plain, wide = (cp.STAGES[k][1](spark, d, sf_dir) for d in both)
    assert wide.columns[:5] == both[0].columns
    cols = plain.columns
    assert sorted(map(repr, wide.select(cols).collect())) == sorted(map(repr, plain.collect())) and plain.count() > 0


def test_operators(spark, sf_dir, both):
    labels = table(spark, sf_dir, "labels")

    def score(d):
        return toxicity.score(d, toxicity.fit(d.drop("toxic").join(labels.select("doc_id", "toxic"), "doc_id"))).select("doc_id", "predicted")

    def lm(d):
        held = id_remainder(F.col("doc_id"), 7) == 2
        model, counts = classlm.train(d.filter(~held), classes=8, words=50, groups=16)
        return classlm.score_texts(d, model, counts, held).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6))

    for f in (
        score,
        lm,
        lambda d: langid.identify(d, langid.fit(d)).select("doc_id", "lang_pred"),
        lambda d: simhash.simhash_groups(d).select("doc_id", "component_id"),
        lambda d: multiset.fingerprint_documents(d, rows_per_bucket=9).select("doc_id", "lanes", "edited_sha256"),
        lambda d: tokencounts.count_tokens(d).select("doc_id", "section", "n_tokens"),
        lambda d: quality.resample(quality.weigh(d, quality.fit(d, labels)), 5).select("doc_id", "sampled"),
    ):
        plain, wide = (sorted(map(repr, f(d).collect())) for d in both)
        assert plain == wide and plain
