from tests.conftest import DATA


def test_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(P.STAGES):
        after = stage(spark, before, str(DATA)).cache()
        if k < len(P.STAGES) - 1:
            assert after.columns == docs.columns, name
            assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        else:
            assert after.count() == before.count()
        before = after
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    run = P.run(spark, str(DATA))
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, before.select(*run.columns).collect()))


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
