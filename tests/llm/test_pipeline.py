import corpus_pipeline as C
from neo.llm import toxicity
from neo.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_near_dedup import brute_groups


def test_stages_follow_brute_force(spark, tmp_dir):
    docs = table(spark, SF_SMALL, "documents")
    bench = [tuple(r) for r in table(spark, SF_SMALL, "benchmark").select("item_id", "text").collect()]
    model = toxicity.train(docs, table(spark, SF_SMALL, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for name, stage in C.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_dir}/{name}")
        after = spark.read.parquet(f"{tmp_dir}/{name}")
        assert after.columns == docs.columns
        got = sorted(r.doc_id for r in after.select("doc_id").collect())
        if name == "toxicity":
            want = [i for i, _ in before if scores[i] < toxicity.THRESHOLD]
        elif name == "exact_dedup":
            want = {r[1] for r in copies(before)[0]}
        elif name == "near_dedup":
            groups = {}
            for (i, _), g in zip(before, brute_groups(before)):
                groups.setdefault(g, []).append(i)
            want = [min(v) for v in groups.values()]
        else:
            want = [r[0] for r in contaminated(before, bench) if not r[5]]
        assert got == sorted(want), name
        docs = after
    assert {r.doc_id for r in C.STAGES[-1][1](spark, docs, SF_SMALL).collect()} == {r.doc_id for r in docs.collect()}


def test_odd_rows_and_empty_tables(spark, odd, none, tmp_dir):
    for k, docs in enumerate((odd, none)):
        n = docs.count()
        for name, stage in C.STAGES[:-1]:
            stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_dir}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_dir}/{k}-{name}")
            assert docs.columns == odd.columns and docs.count() <= n
        if n:
            texts = [r.text for r in docs.collect()]
            assert len(set(texts)) == len(texts) and "one" in texts
        assert C.STAGES[-1][1](spark, docs, SF_SMALL).count() >= docs.count()
