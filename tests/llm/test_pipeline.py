import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import registry, simhash, toxicity
from emberline.llm.common import table


def test_stages_by_brute_force(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
        kept.append({r["doc_id"] for r in docs.select("doc_id").distinct().collect()})
    rows = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    scores = toxicity.score(table(spark, sf, "documents"), toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels")))
    clean = {r["doc_id"] for r in scores.filter("predicted = 0").collect()}
    assert kept[0] == clean
    best = {}
    for d in clean:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in rows[d])
        best[t] = max(best.get(t, d), d)
    assert kept[1] == set(best.values())
    ids = sorted(kept[1])
    prints = np.array([simhash.fingerprint(rows[d]) for d in ids], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    least = np.arange(len(ids))
    while True:
        new = np.where(near, least[None, :], len(ids)).min(axis=1)
        if (new == least).all():
            break
        least = new
    assert kept[2] == {ids[i] for i in set(least)} == kept[3]


def test_run_is_the_stages(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "packing"] and corpus_pipeline.ORACLE_SQL is None
    per = found.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert per.filter("n <> t").count() == 0 and per.count() > 0


def test_sql_of_operators(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        result = con.execute(sql)
        columns = [d[0] for d in result.description]
        found = registry.queries()[name](spark, sf)
        assert sorted(found.columns) == sorted(columns)
        assert sorted(map(str, (tuple(r) for r in found.select(columns).collect()))) == sorted(str(tuple(r)) for r in result.fetchall())
