"""Vector codes against a plain reading in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from spanfit.llm.vector_codes import bounds, nearest, vector_code_report

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plain(rows, entries, rounds, parts=4, scale=1024):
    kept = []
    for i, v, label, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            most = math.floor((1 << 30) / math.sqrt(max(len(v), 1)))
            kept.append((i, [math.floor(max(-most, min(most, float(np.float32(x)) * scale))) for x in v], label))
    out = []
    for dim in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        ends = bounds(dim, parts)
        books = [[r[1][ends[k] : ends[k + 1]] for r in own[:entries]] for k in range(parts)]

        def pick(k, v, books=books, ends=ends):
            cut = v[ends[k] : ends[k + 1]]
            return min((sum((a - b) ** 2 for a, b in zip(cut, c, strict=True)), e) for e, c in enumerate(books[k]))

        for _ in range(rounds):
            chosen = [[pick(k, r[1])[1] for r in own] for k in range(parts)]
            for k in range(parts):
                for e in set(chosen[k]):
                    members = [r[1][ends[k] : ends[k + 1]] for r, c in zip(own, chosen[k], strict=True) if c == e]
                    books[k][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
        digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
        for i, v, label in own:
            best = [pick(k, v) for k in range(parts)]
            out.append([i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label, digest])
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    return sorted(((i, c, e, sums[label], d) for i, c, e, label, d in out), key=str)


def vectors(n, seed=3):
    r = np.random.default_rng(seed)
    base = r.normal(0, 0.2, (6, 16))
    rows = [(int(k * 7 % 101), (base[k % 6] + r.normal(0, 0.02, 16)).astype(np.float32).tolist(), k % 3, "x") for k in range(n)]
    return rows


def test_report_is_plain_reading(spark):
    rows = [
        *vectors(90),
        (None, [0.5] * 16, 1, None), (3, [0.25] * 16, None, "y"), (3, [0.25] * 16, None, "y"), (3, [0.125] * 16, None, "y"),
        (4, None, 1, "z"), (5, [None] + [0.0] * 15, 1, "z"), (6, [float("nan")] * 16, 1, "z"), (7, [float("inf")] * 16, 1, "z"),
        (8, [3e38] * 16, 2, "z"), (9, [-3e38] + [1.0] * 15, 2, "z"), (10, [], 5, "z"), (11, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 5, "z"), (12, [0.1, 0.2, 0.3, 0.4, 0.5, 0.7], None, "z"),
    ]
    got = vector_code_report(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=20, rounds=3)
    assert [f.name for f in got.schema] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got.schema["error"].dataType == got.schema["label_error"].dataType == T.LongType()
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 20, 3)


def test_empty_table(spark):
    assert vector_code_report(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("size", [8, 1 << 12, 1 << 27])
def test_nearest_resolves_what_float32_cannot_tell(size):
    r = np.random.default_rng(size)
    c = r.integers(-size, size, (40, 16))
    c[7] = c[3]  # a tie of entries
    c[20] = c[3] + (np.arange(16) == 5)  # differs in one unit
    p = np.concatenate([r.integers(-size, size, (50, 16)), c, c[3:4] + (np.arange(16) == 5)])
    index, distance, evaluated = nearest(p, c)
    exact = ((p[:, None, :].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    assert index.tolist() == [int(np.argmin(x)) for x in exact] and distance.tolist() == [min(x) for x in exact.tolist()]
    assert index[53] == 3 and index[-1] == 20
    assert len(p) <= evaluated < exact.size / 4


def test_nearest_evaluates_every_entry_of_a_tie():
    p = np.full((3, 4), 5)
    assert nearest(p, np.full((9, 4), 6))[0].tolist() == [0, 0, 0] and nearest(p, np.full((9, 4), 6))[2] == 27
