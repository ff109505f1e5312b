"""Exact dedup, SimHash near-dedup and embedding near-dedup against brute force."""

import hashlib
import itertools
import random
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanfit.llm import common
from spanfit.llm.common import spread_join
from spanfit.llm.components import connected_components
from spanfit.llm.embedding_dedup import CODES, cells, embedding_report, minimal_vectors, nearest_e8, unit
from spanfit.llm.exact_dedup import exact_dedup, exact_report
from spanfit.llm.simhash import _first_chain, chain_keys, fingerprint, links, near_dedup, near_report

DOCS = "doc_id long, text string, source string"


def texts(n=120, seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(r.choices(words, k=r.choice([1, 2, 3, 30, 200]))) for _ in range(n // 4)]
    out = list(base)
    while len(out) < n:
        t = r.choice(base).split()
        if r.random() < 0.6 and len(t) > 3:
            t[r.randrange(len(t))] = r.choice(words)
        out.append(" ".join(t))
    return [*out, None, "", " \t", "A b C", "a B c", "x" * 50_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "no id", "s1"), (5, rows[5][1], "s2")], DOCS)


def smallest(nodes, linked):
    up = {n: n for n in nodes}
    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("room", [1 << 30, 300])
def test_exact_report_is_brute_force(spark, docs, room):
    rows = docs.collect()
    got = sorted((r.asDict() for r in exact_report(docs, table_bytes=room, fanout=3).collect()), key=str)
    want = []
    for r in rows:
        ids = [x.doc_id for x in rows if (x.text or "") == (r.text or "")]
        top = max((i for i in ids if i is not None), default=None)
        want.append({"doc_id": r.doc_id, "keep_id": top, "group_size": len(ids), "kept": r.doc_id == top, "text_sha256": hashlib.sha256((r.text or "").encode()).hexdigest()})
    assert got == sorted(want, key=str)


def test_exact_dedup_keeps_one_row_of_each_text(spark, docs):
    extra = docs.withColumnsRenamed({"source": "rest"}).withColumn("n", F.col("doc_id") % 3)
    for room in (1 << 30, 300):
        got = exact_dedup(extra, table_bytes=room, fanout=3)
        assert got.schema == extra.schema
        kept, rows = got.collect(), extra.collect()
        assert sorted(r.text or "" for r in kept) == sorted({r.text or "" for r in rows})
        for r in kept:
            ids = [x.doc_id for x in rows if (x.text or "") == (r.text or "")]
            assert r in rows and r.doc_id == max((i for i in ids if i is not None), default=None)
    assert exact_dedup(docs.limit(0)).count() == 0 and exact_report(docs.limit(0)).count() == 0


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in texts(60, 3):
        assert fingerprint((t or "").encode()) == plain_fingerprint(t or "")
    assert fingerprint("Ä É x".encode()) == plain_fingerprint("Ä É x")


def test_chains_hold_every_close_pair():
    r = random.Random(2)
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.choice([0, 1, 2, 2, 2])):
            b ^= 1 << bit
        keys = chain_keys(np.array([a, b], np.uint64))
        shared = np.flatnonzero(keys[:, 0] == keys[:, 1])
        assert len(shared)
        first = int(_first_chain(np.array([a ^ b], np.uint64))[0])
        assert first == int(keys[shared[0], 0]) >> 44


@pytest.mark.parametrize("n", [60, 4000])
def test_links_are_brute_force(spark, n):
    r = random.Random(n)
    seeds = [r.getrandbits(64) for _ in range(3)]
    fps = set()
    while len(fps) < n:
        x = r.choice(seeds)
        for bit in r.sample(range(14) if n > 1000 else range(64), r.randrange(8 if n > 1000 else 4)):
            x ^= 1 << bit
        fps.add(x)
    a = np.array(sorted(fps), np.uint64)
    want = set()
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 2):
            want.add((int(a[i]), int(a[i + 1 + j])))
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    got = [tuple(sorted((x.a % 2**64, x.b % 2**64))) for x in links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_report_is_brute_force(spark, docs):
    rows = [(r.doc_id, plain_fingerprint(r.text or "")) for r in docs.collect()]
    by = {}
    for i, f in rows:
        by.setdefault(f, []).append(i)
    fps = list(by)
    top = smallest(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for f in fps:
        least[top[f]] = min([x for x in [*by[f], least.get(top[f])] if x is not None], default=None)
    want = sorted(((i, f"{f:016x}", least[top[f]]) for i, f in rows), key=str)
    assert sorted((tuple(r) for r in near_report(docs).collect()), key=str) == want
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in want if i == c}
    assert near_report(docs.limit(0)).count() == 0 and near_dedup(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(200)] + [(r.randrange(5000, 6000), r.randrange(5000, 6000)) for _ in range(700)] + [(7, 7)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    want = smallest({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_joins_with_hot_keys_lose_and_repeat_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 1 / 20)
    rows = [(k, "hot" if k % 3 else f"k{k}") for k in range(3000)] + [(9000, "alone")]
    many = spark.createDataFrame(rows, "i long, key string")
    few = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("k99999", 4)], "key string, join_part int")
    for how in ("inner", "left", "left_semi"):
        want = sorted(str(tuple(r)) for r in many.join(few, "key", how).collect())
        got = spread_join(many, few, ["key"], "i", how)
        assert sorted(str(tuple(r)) for r in got.collect()) == want
        counted = many.groupBy("key").agg(F.count("*").alias("n"))
        assert sorted(str(tuple(r)) for r in spread_join(many, few, ["key"], "i", how, counted).collect()) == want
    assert spread_join(many.limit(0), few, ["key"], "i").count() == 0


def test_e8_is_the_nearest_point():
    near = minimal_vectors()
    assert near.shape == (240, 8) and np.allclose((near**2).sum(axis=1), 2)
    y = np.random.default_rng(0).uniform(-3, 3, (500, 8))
    p = nearest_e8(y)
    assert np.all(((y - p) ** 2).sum(axis=1) <= 1 + 1e-9)
    assert np.all(((y - p) ** 2).sum(axis=1)[:, None] <= ((y[:, None] - p[:, None] - near) ** 2).sum(axis=2) + 1e-9)
    assert np.all((2 * p).sum(axis=1) % 4 == 0)


@pytest.mark.parametrize(("plan", "dim"), [*((k, 64) for k in range(len(CODES))), (0, 32), (1, 128), (2, 24), (3, 256)])
def test_recall_at_the_threshold(plan, dim):
    rng = np.random.default_rng(3)
    u = unit(rng.standard_normal(((2000, 800, 600, 600)[plan], dim)))
    w = rng.standard_normal(u.shape)
    w = unit(w - (w * u).sum(axis=1, keepdims=True) * u)
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * w
    hit = chance = 0
    first, second = cells(u, plan), cells(v, plan)
    for x, y, z in zip(first, second, np.roll(first, 1, axis=0), strict=True):
        hit, chance = hit + bool((x[:, :, None] == y[:, None, :]).any()), chance + bool((x[:, :, None] == z[:, None, :]).any())
    assert hit / len(u) >= 0.99 and chance / len(u) <= (0.02 if plan == 0 else 0.005)


@pytest.mark.parametrize("plan", range(len(CODES)))
def test_cells_of_a_step_stay_in_proportion(spark, plan, tmp_path, monkeypatch):
    """What is filed takes at most four times the bytes of the vectors, at every step."""
    rng = np.random.default_rng(plan)
    rows = spark.createDataFrame([(k, [float(x) for x in v], 1) for k, v in enumerate(rng.standard_normal((600, 64)))], "vec_id long, embedding array<float>, label int").repartition(1)
    rows.write.parquet(f"{tmp_path}/in")
    most, *how = CODES[plan]
    shared = f"{tmp_path}/shared"
    names = itertools.count()
    monkeypatch.setattr(common, "scratch", lambda _, what: f"file://{shared}/{what}-{next(names)}")
    embedding_report(spark.read.parquet(f"{tmp_path}/in"), codes=((1 << 62, *how),)).count()
    size = lambda folder: sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))
    filed = sum(size(f) for f in Path(shared).glob("cells-*"))
    assert 0 < filed <= 4 * size(f"{tmp_path}/in")


@pytest.mark.parametrize(("block", "codes"), [(2048, CODES), (7, CODES), (7, CODES[1:])])
def test_embeddings_are_brute_force(spark, block, codes):
    rng = np.random.default_rng(7)
    rows, base = [], rng.standard_normal((12, 64))
    for k in range(160):
        v = base[k % 12] + rng.standard_normal(64) * (0.02 if k % 2 else 0.12)
        rows.append((k, [float(x) for x in np.float32(v)], int(k % 3) if k % 12 else 0))
    rows += [(200 + k, rows[4][1], rows[4][2]) for k in range(20)]
    rows += [(300, None, 0), (301, [0.0] * 64, 0), (302, [float("nan")] * 64, 0), (303, [None] * 64, 0), (304, rows[0][1], None), (305, [], 0), (306, rows[0][1][:32], 0), (307, [x * 2 for x in rows[0][1]], 0), (308, rows[0][1], 0), (308, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in embedding_report(df, block=block, codes=codes).collect())
    n, linked, near = len(rows), [], [0] * len(rows)
    ok = [r[1] is not None and r[2] is not None and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and any(r[1]) for r in rows]
    for i, j in itertools.combinations(range(n), 2):
        if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            a, b = (unit(np.array([np.float32(rows[k][1])], float))[0] for k in (i, j))
            if a @ b >= 0.93:
                linked.append((i, j))
                near[i] += 1
                near[j] += 1
    top = smallest(range(n), linked)
    least = {}
    for k in range(n):
        least[top[k]] = min(least.get(top[k], 10**9), rows[k][0])
    want = sorted((rows[k][0], near[k], least[top[k]], rows[k][0] == least[top[k]]) for k in range(n))
    assert got == want
    assert embedding_report(df.limit(0)).count() == 0
