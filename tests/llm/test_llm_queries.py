"""The registered queries against their SQL, and the pipeline against its stages, on the smallest tables."""

from pathlib import Path

import pytest

import corpus_pipeline
from labelmill.llm.queries import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, str(FOLDER))
    order = sorted(df.columns)
    result = connection.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == order
    expected = sorted(repr(tuple(row[columns.index(c)] for c in order)) for row in result.fetchall())
    assert sorted(repr(tuple(row)) for row in df.select(*order).collect()) == expected


def test_pipeline_works_on_what_each_stage_kept(spark):
    from test_operators import brute_components, brute_hits, brute_removed

    folder = str(FOLDER)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if name != "toxicity" else None
        docs = stage(spark, docs, folder).persist()
        assert name == "byte_bpe" or docs.columns == columns
        seen.append(name)
        if name == "near_duplicates":
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, _, kept) in brute_components(list(before.items())).items() if kept}
        if name == "suffix_dedup":
            removed = brute_removed(before.items())
            for r in docs.collect():
                assert r.n_chars == len(r.text) and len(r.text.encode()) <= removed[r.doc_id][0] - removed[r.doc_id][1]
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert {r.doc_id for r in docs.collect()} == {i for i, row in brute_hits(list(before.items()), items).items() if not row[4]}
    assert seen == ["toxicity", "near_duplicates", "suffix_dedup", "decontamination", "byte_bpe"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, docs.collect()))
