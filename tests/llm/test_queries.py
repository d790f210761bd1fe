"""The registered queries on the smallest tables: SQL where there is some, else brute force."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from mapweft.llm import bpe, queries, toxicity
from mapweft.llm.jaccard import similar_documents
from mapweft.llm.mixing import mix

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    key = ["doc_id"] if "doc_id" in names else ["part", "filter_order", "step"]
    pd.testing.assert_frame_equal(
        got[names].sort_values(key).reset_index(drop=True), want[names].sort_values(key).reset_index(drop=True), check_dtype=False, check_exact=False
    )


def test_every_operator_is_registered_once():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.toPandas()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs.toPandas())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(kept[0].columns)
    start, clean, lines, unique, mixed, ids = kept
    frame = lambda p: spark.createDataFrame(p)
    model = toxicity.train(frame(start), spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out()))
    scores = toxicity.score(frame(start), model).toPandas()
    assert set(clean.doc_id) == set(scores.doc_id[scores.score < 0.3])
    seen = {}
    for d, s, t in zip(clean.doc_id, clean.source, clean.text):
        for x in set(t.split("\n")):
            if x.strip(" "):
                seen.setdefault(x, []).append((d, s))
    bad = {x: min(d for d, _ in v) for x, v in seen.items() if len({s for _, s in v}) >= corpus_pipeline.MIN_SITES}
    want = {d: "\n".join(x for x in t.split("\n") if bad.get(x, d) == d) for d, t in zip(clean.doc_id, clean.text)}
    assert dict(zip(lines.doc_id, lines.text)) == want
    groups = similar_documents(frame(lines)).toPandas()
    assert set(unique.doc_id) == set(groups.component_id) and len(unique) == len(set(groups.component_id))
    taken = mix(frame(unique)).toPandas().set_index("doc_id")
    times = mixed.doc_id.value_counts()
    for d, r in taken.iterrows():
        assert times.get(d, 0) * r["size"] == r.taken
    assert len(ids) == len(mixed)
    texts = mixed.drop_duplicates("doc_id").set_index("doc_id").text
    encoder = bpe.Encoder(bpe.vocabulary_path())
    for d, own in zip(ids.doc_id, ids.ids):
        assert list(own) == encoder.tokenizer.encode(texts[d], add_special_tokens=False).ids


def test_run_is_all_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
