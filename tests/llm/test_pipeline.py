"""The pipeline, stage by stage, against plain versions of its stages."""

import duckdb

import corpus_pipeline
from tests.llm import brute
from workweave.llm.sql import STATEMENTS
from workweave.llm.tables import save


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, small), "stage")
        kept.append(docs)
    assert all(df.columns == columns for df in kept[:-1])
    texts = [{r.doc_id: r.text for r in df.collect()} for df in kept[:-1]]

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    judged = con.sql(f"SELECT doc_id FROM ({STATEMENTS['op4_quality_rules']}) WHERE kept").fetchall()
    assert set(texts[0]) == {d for d, in judged}
    lines = brute.dedup_lines(texts[0].items())
    assert texts[1] == {d: t for d, t in lines.items() if t.strip()}
    near = brute.ngram_components(texts[1].items())
    assert set(texts[2]) == {d for d, (_, c) in near.items() if c == d}
    items = [" ".join(t.split()) for t, in con.sql("SELECT text FROM benchmark").fetchall()]
    assert set(texts[3]) == {d for d, t in texts[2].items()
                             if not any(i in " ".join(t.split()) for i in items)}
    packed = kept[-1].collect()
    assert {r.doc_id for r in packed} == set(texts[3])
    assert len({r.sequence_id for r in packed}) == brute.best_fit([r.length for r in packed], 2048)
