"""Removal of repeated byte strings against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spanfit.llm.suffix_dedup import anchors, merge_spans, multikey_quicksort, seed_bytes, suffix_report, unpack

SCHEMA = "doc_id long, text string, n_bytes string"


def plain(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of all rows, sorted."""
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(x[k : k + length] for _, x in data for k in range(len(x) - length + 1))
    out = []
    for i, x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def texts(seed, alphabet, n=60, longest=120):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    shared = [word(r.randrange(5, 60)) for _ in range(6)]
    rows = [(k, "".join(r.choice([word(r.randrange(1, longest // 3)), r.choice(shared), r.choice(shared)[3:], r.choice(shared)[:-2]]) for _ in range(r.randrange(1, 5))), "x") for k in range(n)]
    return [*rows, (None, rows[3][1], "x"), (7, rows[7][1], "x"), (200, None, "x"), (201, "", "x"), (202, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x"), (203, "short", "x")]


@pytest.mark.parametrize(("length", "block", "seed", "alphabet", "bucket"), [(12, 4, 1, "abcdefgh é", 1 << 20), (12, 5, 2, "ab", 300), (20, 7, 3, "abcdefghijklmnop", 200), (9, 9, 4, "abc", 500), (8, 1, 5, "abcd", 1000)])
def test_report_is_brute_force(spark, length, block, seed, alphabet, bucket):
    rows = texts(seed, alphabet)
    got = suffix_report(spark.createDataFrame(rows, SCHEMA).repartition(3), length=length, block=block, bucket_bytes=bucket, scan_bytes=bucket)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, length)


def test_windows_of_200_bytes(spark):
    r = random.Random(9)
    word = lambda k: "".join(r.choice("etaoin shrdlu") for _ in range(k))
    passage, other = word(450), word(230)
    rows = [(k, word(r.randrange(50, 900)) + (passage[r.randrange(0, 100) :] if k % 3 else other[k : k + 199 + k % 4]) + word(r.randrange(0, 500)), "x") for k in range(60)]
    rows += [(100, passage * 3, "x"), (101, "é" * 400 + "日本" * 90, "x"), (102, word(120_000) + passage + word(3), "x"), (103, rows[5][1], "x"), (104, "z" * 5000, "x")]
    assert sorted(map(tuple, suffix_report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()), key=str) == plain(rows, 200)


def test_a_core_over_many_buckets(spark):
    """One passage in all texts, with different letters around it: its suffixes fill several buckets."""
    r = random.Random(11)
    rows = [(k, "".join(r.choice("abcdef") for _ in range(30)) + "the passage that all have" + "".join(r.choice("abcdef") for _ in range(30)), "x") for k in range(150)]
    got = suffix_report(spark.createDataFrame(rows, SCHEMA).repartition(3), length=24, block=8, bucket_bytes=2000)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 24)


def test_empty_table(spark):
    assert suffix_report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert suffix_report(spark.createDataFrame([(1, None, "x"), (None, "a", "x")], SCHEMA)).count() == 2


def test_anchors_own_each_window_once():
    r = random.Random(5)
    data = ["".join(r.choice("ab") for _ in range(n)).encode() for n in (0, 11, 12, 13, 300, 5, 80)] + [b"a" * 60]
    text, lo, hi, at, g, c = anchors(data, 12)
    owned = Counter((t, k) for t, a, b in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True) for k in range(a, b + 1))
    assert owned == Counter((t, k) for t, x in enumerate(data) for k in range(len(x) - 11))
    assert ((lo <= at) & (at <= lo + 12 - seed_bytes(12)) & (hi <= at)).all()
    # Equal windows have their anchor in the same place.
    where = {}
    for t, a, b, p in zip(text.tolist(), lo.tolist(), hi.tolist(), at.tolist(), strict=True):
        for k in range(a, b + 1):
            assert where.setdefault(data[t][k : k + 12], p - k) == p - k


def test_multikey_quicksort():
    r = np.random.default_rng(1)
    for n, depth in ((0, 2), (1, 1), (500, 3), (2000, 2)):
        words = r.integers(0, 6, (n, depth)).astype(np.uint64) << np.uint64(60)
        order, same = multikey_quicksort(words)
        want = sorted(words.tolist())
        assert words[order].tolist() == want and same.tolist() == [k > 0 and want[k] == want[k - 1] for k in range(n)]


def test_spans_that_touch_are_one():
    assert merge_spans(np.array([[5, 9], [0, 3], [3, 4], [6, 12], [20, 21]])).tolist() == [[0, 4], [5, 12], [20, 21]]
    assert [x.tolist() for x in unpack(np.array([7 << 24 | 5 << 12 | 6]))] == [[7], [12], [13]]
