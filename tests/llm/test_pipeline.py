import corpus_pipeline as cp
from riskloom.llm.common import table
from tests.llm.test_decontaminate import plain, words
from tests.llm.test_nearcopies import plain_kept


def test_stages_in_turn(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "language_id", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        assert docs.columns[: len(columns)] == columns and all(after[i][c] == before[i][c] for i in after for c in columns)
        if name == "quality_classifier":
            good = [i for i in before if labels.get(i) == 1]
            bad = [i for i in before if labels.get(i) == 0]
            assert sum(i in after for i in good) >= 0.97 * len(good) and sum(i in after for i in bad) <= 0.1 * len(bad)
        elif name == "language_id":
            assert len(after) >= 0.99 * len(before)
        elif name == "simhash_near_dedup":
            assert sorted(after) == plain_kept([(i, r.text) for i, r in before.items()])
        elif name == "benchmark_decontamination":
            gone = set(before) - set(after)
            lines = {i: f" {' '.join(words(r.text))} " for i, r in before.items()}
            grams = [(n, t, {" ".join(words(t)[j : j + 13]) for j in range(max(1, len(words(t)) - 12))}) for n, t in items if words(t)]
            for i, r in before.items():
                near = [(n, t) for n, t, g in grams if any(f" {x} " in lines[i] for x in g)]
                assert plain(r.text, near)[3] == (i in gone)
        else:
            assert set(after) == set(before) and sorted(r.mix_position for r in after.values()) == list(range(len(after)))


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir).collect()
    assert len(out) > 100 and [r.mix_position for r in out] == list(range(len(out)))


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and long texts, repeated rows, and no rows at all."""
    docs = table(spark, sf_dir, "documents")
    some = [tuple(r) for r in docs.filter("doc_id < 40").collect()]
    long = "That and onesen erblest it hein " * 30000
    odd = some + [some[3], some[3], (None, some[5][1], None, None, None), (None, None, "en", "src1", 0), (900, None, "en", None, 0), (901, "", None, "src2", 0), (902, " \n\t ", "en", "src2", 4), (903, "12 34 !!", "en", "src2", 8), (904, long, "en", "src3", len(long)), (905, some[4][1], some[4][2], some[4][3], some[4][4])]
    df = spark.createDataFrame(odd, docs.schema)
    for k, (_, stage) in enumerate(cp.STAGES):
        got = stage(spark, df, sf_dir).collect()
        given = [tuple(r[:5]) for r in got]
        if k == 1:  # the language found takes the place of the one given
            known = {r[2] for r in odd} - {None}
            assert all(g[2] in known for g in given)
            bare = [(*r[:2], *r[3:]) for r in odd]
            assert all((*g[:2], *g[3:]) in bare for g in given)
        else:
            assert all(g in odd for g in given)
        if k == 0:
            assert not [g for g in given if not (g[1] or "").strip()]
        if k == 1:
            assert not [g for g in given if g[0] in (900, 901, 902, 903)] and any(g[0] == 904 for g in given)
        if k == 2:
            assert given.count(some[3]) == 1 and sum(g[1] == some[4][1] for g in given) == 1
            assert sum(not (g[1] or "").strip() for g in given) == 1
        if k == 3:
            assert sum(g == some[3] for g in given) in (0, 3) and any(g[0] == 904 for g in given)
        if k == 4:
            assert len(given) == len(odd) and sorted(r.mix_position for r in got) == list(range(len(odd)))
        assert stage(spark, df.limit(0), sf_dir).count() == 0
