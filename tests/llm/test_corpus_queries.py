"""The registered queries on the smallest tables, and the pipeline over them."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
import corpus_pipeline
from check import TABLES, normal
from sunmeter.llm import html_text, queries, simhash, toxicity
from sunmeter.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SF).toArrow()
    want = db.sql(queries.ORACLES[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    assert got.num_rows > 0 and normal(got.to_pylist()) == normal(want.to_pylist())


def test_all_are_registered():
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert {*queries.QUERIES, "pipeline"} <= set(entries.queries())


def test_every_document_has_a_row(spark):
    docs = table(spark, SF, "documents").count()
    for name in ("op2_toxicity", "op5_simhash_groups", "op7_source_mix", "op8_secret_scan",
                 "op9_bpe_codec", "op11_fill_middle", "op13_chunked_bpe"):
        rows = queries.QUERIES[name](spark, SF)
        assert rows.count() == rows.select("doc_id").distinct().count() == docs


def test_digests_of_spans(spark):
    for row in queries.op8_secret_scan(spark, SF).filter("n_assign + n_hex > 0").collect():
        kinds = Counter(span.split(":")[0] for span in row["spans"].split(","))
        assert (kinds["assign"], kinds["access"], kinds["hex"], kinds["live"]) == (
            row["n_assign"], row["n_access"], row["n_hex"], row["n_live"])


def test_decoded_texts_are_the_documents(spark):
    docs = table(spark, SF, "documents").select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    got = queries.op9_bpe_codec(spark, SF).join(docs, "doc_id")
    assert got.filter("sha <> decoded_sha256").count() == 0


def test_pages_have_their_article(spark):
    rows = queries.op6_html_text(spark, SF).collect()
    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    assert len(rows) == len(pages)
    for row in rows:
        inside = [t for name, t, part in html_text.events(pages[row["page_id"]])
                  if name == html_text.WORD and part == html_text.INSIDE]
        assert row["n_chars"] == len(row["text"])
        assert row["text"].split() == html_text.html.unescape(" ".join(inside)).split()


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if name == "toxicity":
            rejected = toxicity.score(before, model).filter("rejected").count()
            assert sizes[-1] == sizes[-2] - rejected
        if name == "line_dedup":
            assert sizes[-1] == sizes[-2]
        if name == "simhash_near_dedup":
            assert sizes[-1] == simhash.groups(before).select("component_id").distinct().count()
            assert docs.select("doc_id").distinct().count() == sizes[-1]
    assert sizes[-1] == sizes[-2] > 0
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))
