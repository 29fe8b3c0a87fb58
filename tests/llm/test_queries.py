"""The registered queries: SQL, the pipeline against plain versions of its stages, and the guard of the entry module."""

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dictspark.llm import langid, queries
from tests.llm.helpers import clashing, rng, sentence
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_langid import plain_identify as languages
from tests.llm.test_linedup import brute as without_lines
from tests.llm.test_minhash import brute as near
from tests.test_oracle import SF, TABLES, rows

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    out = con.execute(queries.oracle_sql()[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows([c[0] for c in out.description], out.fetchall())


def test_ten_queries():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


def plain_pipeline(rows, items, found=None):
    """(doc_id, text, lang) of the documents that stay, by plain versions of the stages. rows: (doc_id, text, lang) with distinct ids. found:
    rows as the language query gives them (which has a test of its own), where the plain form takes long."""
    found = {i: (lang, bits) for i, _, lang, _, bits in found or languages(rows)}
    learned = any(lang != "und" for lang, _ in found.values())
    kept = []
    for i, t, lang in rows:
        own, bits = found[i]
        if any(c.isalpha() for c in t or "") and (not learned or bits * len(t) <= langid.REJECT_BITS * (len(t) + langid.REJECT_FREE)):
            kept.append((i, t, lang if lang is not None or not learned else own))
    lang = {i: x for i, _, x in kept}
    given = [(i, t) for i, t, _, gone in without_lines([x[:2] for x in kept]) if not gone or (t or "").split()]
    keep = {x[0] for x in near(given, 80) if x[3]}
    given = [x for x in given if x[0] in keep]
    clean = {x[0] for x in contaminated(given, items, 8, 0) if x[3] == 0}
    return sorted((i, t, lang[i]) for i, t in given if i in clean)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain_pipeline([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], items, langid.identify(docs).collect())
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in out) == want
    assert all(r["__ds_bucket_len"] >= r["__ds_n_tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) and r["n_chars"] == len(r["text"]) for r in out)


def corpus(spark, at, rows, items):
    """A folder with documents (with further columns whose names the stages use themselves) and benchmark."""
    table = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clashing(table).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("labels", [True, False])
def test_pipeline_on_odd_rows(spark, tmp_path, labels):
    """Nulls, empty and long texts, no labels, ids or columns of its own to rely on: the plain versions' rows; repeats and rows without an id are
    looked at by their texts."""
    r = rng(21)
    item = sentence(r, 12)
    base = [sentence(r, 60) for _ in range(12)]
    rows = [(i, t, "en" if labels else None) for i, t in enumerate(base)]
    rows += [(100, None, "en" if labels else None), (101, "", None), (102, "12 34 !", None), (103, base[0] + " x", None), (104, sentence(r, 30) + " " + item + " z", None), (105, sentence(r, 9_000), None), (106, "A.", None), (107, "漢字" * 90, None)]
    rows += [(200 + i, f"{sentence(r, 20)}\nand this is one of the lines that stand in many of the texts number {i}", None) for i in range(4)]
    items = [(1, item), (2, None), (3, "")]
    twice = [(3, base[3], None), (None, base[4], None), (None, sentence(rng(22), 40), None), (None, None, None)]
    out = corpus_pipeline.run(spark, corpus(spark, tmp_path / "odd", rows + twice, items))
    got = sorted(((x["doc_id"], x["text"], x["lang"]) for x in out.collect()), key=repr)
    own = [x for x in got if x[0] is not None]
    assert own == sorted(plain_pipeline(rows, items), key=repr)
    assert [x[1] for x in got if x[0] is None] == [twice[2][1]]
    names = spark.read.parquet(str(tmp_path / "odd/documents.parquet")).columns
    assert out.columns == [*names, *(f"__ds_{c}" for c in ("n_tokens", "bucket", "bucket_len", "batch_id", "slot"))]


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, corpus(spark, tmp_path / "none", [], [])).collect() == []
    text = sentence(rng(23), 30)
    assert [x["text"] for x in corpus_pipeline.run(spark, corpus(spark, tmp_path / "one", [(1, text, None)], [])).collect()] == [text]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("key", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_entry_without_the_subpackage(tmp_path):
    """The rest works where the subpackage is gone; a real import error in it is not hidden."""
    repo = Path(__file__).parents[2]
    for p in ("__spark_entry__.py", "dictspark"):
        subprocess.run(["cp", "-r", repo / p, tmp_path], check=True)
    subprocess.run(["rm", "-r", tmp_path / "dictspark/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q) > 30, any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    run = lambda: subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.split() == ["True", "False", "True"]
    (tmp_path / "dictspark/llm").mkdir()
    (tmp_path / "dictspark/llm/__init__.py").write_text("")
    (tmp_path / "dictspark/llm/queries.py").write_text("import no_such_module_at_all\n")
    assert "no_such_module_at_all" in run().stderr
