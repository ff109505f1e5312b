"""The pipeline on a small corpus: each stage against what its operator does alone, and the entry module without it."""

import random

import pytest

import corpus_pipeline
from spanfit.llm import queries as llm
from spanfit.llm.simhash import fingerprint


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for k in range(240):
        bad = k % 6 == 0
        t = " ".join(f"{w}###" if bad else w for w in r.choices(words, k=60)) + ("" if bad else ".")
        rows.append((k, t, "en", f"s{k % 4}", len(t)))
        labels.append((k, int(not bad), 0))
    rows += [(300 + k, rows[1][1], "en", "s0", 1) for k in range(5)] + [(400, rows[2][1] + " w1", "en", None, 2), (500, "", "en", "s1", 0), (501, None, "en", "s1", None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < 4:
            assert docs.columns == names
        seen.append(docs.collect())
    start, good, exact, near, mixed, tokens = seen
    assert not {r.doc_id for r in good} & set(range(0, 240, 6)) and {r.doc_id for r in start if r.doc_id < 240 and r.doc_id % 6} <= {r.doc_id for r in good}
    texts = {}
    for r in good:
        texts[r.text or ""] = max(r.doc_id, texts.get(r.text or "", -1))
    assert sorted(r.doc_id for r in exact) == sorted(texts.values())
    prints = {r.doc_id: fingerprint((r.text or "").encode()) for r in exact}
    up = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    up[a] = up[b] = min(up[a], up[b])
        if all(up[up[i]] == up[i] for i in up):
            break
    assert sorted(r.doc_id for r in near) == sorted(set(up.values()))
    sizes = {}
    for r in near:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and len(mixed) == len(tokens) and all(r.same for r in tokens)
    assert abs(sum(len((r.text or "").split()) for r in mixed) - sum(sizes.values())) <= 61 * 3 * len(sizes)
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, tokens))


def test_queries_are_named_for_operators():
    names = list(llm.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] and llm.oracle_sql().keys() <= llm.queries().keys()
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_stage", "exact_stage", "near_stage", "mix_stage", "token_stage"]


def test_stages_of_empty_tables_and_clashing_columns(spark, sf_dir, tmp_path):
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []
    clash = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "doc_id AS score", "text AS quality", "lang AS n", "source AS hash", "doc_id AS target", "text AS copies", "lang AS component_id")
    clash.write.parquet(str(tmp_path / "clash" / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "clash" / "labels.parquet"))
    same = lambda rows: sorted((r.doc_id if r.doc_id is not None else -1, r.ids_hash) for r in rows.collect())
    assert same(corpus_pipeline.run(spark, str(tmp_path / "clash"))) == same(corpus_pipeline.run(spark, sf_dir))
