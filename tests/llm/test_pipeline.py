"""The queries on the smallest tables, against SQL and plain versions; the pipeline stage by stage."""

import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import mixing, tokens, toxicity
from keyloom.llm.registry import ORACLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, name):
    from keyloom.llm.registry import QUERIES

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    cursor = con.execute(ORACLES[name])
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


def sets(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return w, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_pipeline(spark):
    docs = spark.read.parquet(DATA + "/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(DATA + "/labels.parquet"))
    keep = [i for i, r in rows.items() if model.above(np.array([model.raw(r.text)]))[0, 0] < 0.5]
    shingles = {i: sets(rows[i].text)[1] for i in keep}
    root = {i: i for i in keep}
    for _ in range(4):
        for a in keep:
            for b in keep:
                both = len(shingles[a] & shingles[b])
                if both and 100 * both >= 75 * (len(shingles[a]) + len(shingles[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    keep = [i for i in keep if root[i] == i]
    items = [" " + " ".join(sets(r.text)[0]) + " " for r in spark.read.parquet(DATA + "/benchmark.parquet").collect()]
    leaks = {i for i in keep if any(x in " " + " ".join(sets(rows[i].text)[0]) + " " for x in items)}
    frame = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, DATA)
        assert frame.columns == docs.columns, name
        kept.append({r.doc_id for r in frame.collect()})
    assert kept[1] == set(keep)
    assert leaks <= kept[1] - kept[2] and len(kept[1] - kept[2]) <= len(leaks) + 3  # passages with a word changed count too
    weights = mixing.quality_weights(spark.read.parquet(DATA + "/labels.parquet"))
    taken = {r.doc_id: r.taken // r.size for r in mixing.plan(mixing.sized(frame, weights)).where("taken > 0").collect()}
    mixed = corpus_pipeline.mixed(spark, frame, DATA)
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == taken
    e = tokens.encoder(tokens.tokenizer_path())
    at = 0
    for r in corpus_pipeline.run(spark, DATA).orderBy("start").collect():
        n = len(e.whole.encode(rows[r.doc_id].text or "", add_special_tokens=False).ids) + 1
        assert (r.start, r.n_tokens) == (at, n)
        at += n
    assert mixed.select(F.sum("n_chars")).first()[0] == sum(rows[i].n_chars * k for i, k in taken.items())


def test_pipeline_of_odd_rows(spark, odd, none, labels, tmp_path):
    d = str(tmp_path)
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "some words that nobody else would ever write down here"), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    for frame in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame_out = stage(spark, frame, d)
            assert frame_out.columns == frame.columns, name
            frame = frame_out
        rows = corpus_pipeline.STAGES[-1][1](spark, frame, d).collect()
        assert len(rows) == frame.count()
