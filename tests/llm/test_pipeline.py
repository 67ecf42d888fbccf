import corpus_pipeline as cp
from recallforge.llm import queries
from recallforge.llm.common import table
from tests.conftest import SMALL
from tests.llm.conftest import ODD


def test_stages_filter_and_keep_columns(spark):
    docs = table(spark, SMALL, "documents")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality classifier", "language id", "simhash near-dedup", "source mixing", "best-fit packing"]
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    kept = cp.keep_quality(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sum(labels[i] == 0 for i in ids(kept) if i in labels) <= 1 and sum(labels.get(i) == 1 for i in ids(kept)) >= 0.95 * sum(labels.values())
    extra = spark.createDataFrame([(10_001, "12 34 56", "en", "src0", 8)], docs.schema)
    known = cp.keep_language(spark, docs.union(extra), SMALL)
    assert known.columns == docs.columns and 10_001 not in ids(known) and known.count() >= 0.97 * docs.count()
    one = cp.keep_one_of_each(spark, docs, SMALL)
    from recallforge.llm.simhash import near_duplicates

    assert sorted(ids(one)) == sorted({r.component_id for r in near_duplicates(docs).collect()}) and one.columns == docs.columns
    mixed = cp.mix_sources(spark, one, SMALL)
    assert mixed.columns == docs.columns and max(ids(mixed).count(i) for i in set(ids(mixed))) <= 3


def test_one_of_each_with_nulls_and_repeats(docs, spark):
    d = docs("a b c d e f", "a b c d e f", "a b c d e f", "q", None, ids=[2, 1, 1, None, 9])
    got = cp.keep_one_of_each(spark, d, SMALL)
    assert got.columns == d.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "9", "None"]


def test_garbled_and_mixed_texts_go_and_clean_ones_stay(spark, monkeypatch):
    import random

    import numpy as np

    docs, r = table(spark, "/root/testdata/sf0.01", "documents"), random.Random(1)
    net = cp.langid.fit(docs)
    monkeypatch.setattr(cp.langid, "fit", lambda d: net)
    rows = [x for x in docs.where("length(text) > 1200").orderBy("doc_id").collect()]
    by = {}
    for x in rows:
        by.setdefault(x.lang, []).append(x.text)
    chance = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") if r.random() > 0.15 else " " for _ in range(n)) for n in (300, 1000, 3000, 10_000) * 5]
    mixed_up = [cp.langid.garbled(x.text[:n], np.random.default_rng(i)) for i, x in enumerate(rows[:20]) for n in (400, 1200)]
    langs = sorted(by)
    quarters = ["".join(by[k][i][:300] for k in langs) for i in range(min(map(len, by.values())))]
    clean = [x.text[:n] for x in rows[:60] for n in (60, 120, 300, 1200)]
    make = lambda texts, first: spark.createDataFrame([(first + i, t, None, "src0", len(t)) for i, t in enumerate(texts)], docs.schema)
    share = lambda texts: cp.keep_language(spark, make(texts, 0), SMALL).count() / len(texts)
    assert share(chance) <= 0.1 and share(mixed_up) <= 0.1 and share(clean) >= 0.99
    assert len(langs) >= 4 and len(quarters) >= 5 and share(quarters) <= 0.2
    assert share([None or "", "12 34 56", "!!"]) == 0


def test_stages_on_odd_tables(spark, docs, tmp_path):
    """Every stage on nulls, empty, very long and repeated texts with clashing column names, and on an empty table."""
    d = docs(*ODD, "plain words of a text " * 20_000, ids=[1, 1, None, *range(8)])
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES:
        got = stage(spark, d, str(tmp_path))
        rows = got.collect()
        none = stage(spark, d.where("false"), str(tmp_path))
        assert none.collect() == [] and none.columns == got.columns
        if name != "best-fit packing":
            assert got.columns == d.columns and len(rows) <= 3 * d.count()


def test_run(spark):
    got = cp.run(spark, SMALL).collect()
    assert got and {"doc_id", "sequence_id", "offset"} <= set(got[0].asDict())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
