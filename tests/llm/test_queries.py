"""The registered queries against their SQL, and the pipeline's stages."""

import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from undula.llm import language, queries, shared, surrogates

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import brute_components, brute_fingerprint, brute_hits, check_places, ids_of  # noqa: E402


def plain(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    made = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(made.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in made.collect()) == plain(tuple(r[k] for k in at) for r in sql.fetchall())


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 13))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "contamination", "personal_data", "packing"]


def test_pipeline_is_brute_force(spark, sf):
    """Every stage's rows from those before it: classified, compared, matched, replaced and tokenised one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("entities", F.lit(1))
    docs = docs.union(docs.limit(3)).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(-1).cast("long")))
    before, stages = [r.asDict() for r in docs.collect()], dict(corpus_pipeline.STAGES)

    def stage(name):
        nonlocal docs
        out = stages[name](spark, docs, sf)
        assert out.columns == docs.columns or name == "packing"
        docs = shared.stored(out, name)
        return [r.asDict() for r in docs.collect()]

    model = language.train(docs)
    names, _, _, rejected = model.classify([r["text"] for r in before])
    want = [r | {"lang": r["lang"] or name} for r, name, gone in zip(before, names, rejected, strict=True) if not gone]
    got = stage("language")
    assert as_rows(got) == as_rows(want) and len(got) < len(before)

    prints = [brute_fingerprint(r["text"]) for r in got]
    roots = brute_components(prints)
    first = {}
    for k, r in enumerate(got):
        least = first.setdefault(roots[k], r)
        if r["doc_id"] < least["doc_id"]:
            first[roots[k]] = r
    want, got = list(first.values()), stage("near_copies")
    assert as_rows(got) == as_rows(want)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = []
    for r in got:
        n, hits, *_ = brute_hits(r["text"], items)
        if not (hits and 20 * hits >= n):
            want.append(r)
    got = stage("contamination")
    assert as_rows(got) == as_rows(want)

    key = surrogates.session_key(spark)
    attempts = {bytes(r.token): r.attempt for r in surrogates.settle(docs, key)[0].collect()}
    want = []
    for r in got:
        new, found = surrogates.replace(r["text"], surrogates.Cipher(key), attempts)
        want.append(r | {"text": new, "n_chars": len(new) if found else r["n_chars"]})
    got = stage("personal_data")
    assert as_rows(got) == as_rows(want)

    want = []
    for r in got:
        ids = [*ids_of(r["text"]), 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        cuts = [0, len(ids)] if len(ids) <= 2048 else cuts
        want += [(r["doc_id"], k, x, y - x, zlib.crc32(np.array(ids[x:y], "<u4").tobytes())) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = stage("packing")
    assert sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == sorted(want)
    check_places(docs.collect(), 2048)


def as_rows(rows):
    return sorted(str(sorted(r.items())) for r in rows)


def test_pipeline_runs_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.stored(stage(spark, docs, sf), name)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert sorted(tuple(r[c] for c in columns) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(tuple(r[c] for c in columns) for r in docs.collect())


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
