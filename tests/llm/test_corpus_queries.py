"""The registered queries and the pipeline on the smallest tables."""

import collections
import hashlib
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from folioflow.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mixture_of_sources", "encode"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    cur = con.execute(SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = collections.Counter(tuple(r[i] for i in at) for r in cur.fetchall())
    assert collections.Counter(map(tuple, df.select(*cols).collect())) == want


def test_secret_digests(spark):
    got = {r["doc_id"]: r for r in QUERIES["op6_secrets"](spark, FOLDER).collect()}
    hexes = re.compile(r"[0-9a-f]{24,}")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        assert got[r["doc_id"]]["n_hex"] == len(hexes.findall(r["text"]))
        spans = [s for s in got[r["doc_id"]]["spans"].split(",") if s and not s.startswith("markov")]
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert first.columns == docs.columns and first.count() == docs.count()
    second = corpus_pipeline.line_dedup(spark, first, FOLDER)
    assert second.columns == docs.columns and second.where("text = ''").count() == 0
    kept = {r["doc_id"]: r for r in second.collect()}
    was = {r["doc_id"]: r for r in docs.collect()}
    for i, r in kept.items():  # lines only go, and none goes from a document that shares none
        lines = was[i]["text"].split("\n")
        assert collections.Counter(r["text"].split("\n")) <= collections.Counter(lines) and r["n_chars"] <= was[i]["n_chars"]
    third = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := r["text"].lower().split()) else set() for i, r in was.items()}
    left = {r["doc_id"] for r in third.collect()}
    assert left < set(was) and 0 in left
    for i in set(was) - left:  # what goes has a smaller near-duplicate
        assert any(sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in was if j < i)
    mixed = corpus_pipeline.mixture_of_sources(spark, docs, FOLDER)
    assert mixed.columns == docs.columns and abs(mixed.count() - len(was)) < 60
    assert corpus_pipeline.encode(spark, docs, FOLDER).count() == len(was)
