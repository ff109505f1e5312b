"""Line dedup against a brute-force template tree."""

import random
import re

import pytest

from spanfit.llm import line_dedup
from spanfit.llm.line_dedup import drop_lines, line_report


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    fixed = ["All rights reserved by the makers of it", "one two three", "Page 12 of 99 printed on paper"]
    rows = []
    for k in range(60):
        lines = [" ".join(r.choices(words, k=r.choice([2, 6, 30]))) for _ in range(5)]
        if k % 3 == 0:
            lines.insert(2, fixed[0])
        if k % 4 == 0:
            lines += [fixed[1], f"Page {k} of {k * k} printed on paper", ""]
        if k % 5 == 0:
            lines.append(f"Posted by user {r.choice(words)}{'q' * k} in the forum of news today at noon")
        rows.append((k, "\n".join(lines), "x"))
    rows += [(100, None, "x"), (101, "", "x"), (None, fixed[0], "x"), (3, rows[3][1], "x"), (102, "\n \n", None), (103, (fixed[0] + "\n") * 2000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, dropped_lines string")


def brute(rows, min_docs=5, min_tokens=4, constant=0.7, lead=4):
    def tokens(x):
        return tuple("<*>" if re.search("[0-9]", t) else t for t in x.split())
    docs = [[tokens(x) for x in (r.text or "").split("\n")] for r in rows]
    n = {}
    for d in docs:
        for t in set(d):
            if len(t) >= min_tokens:
                n[t] = n.get(t, 0) + 1
    template = {}
    for t in n:
        same = [u for u in n if len(u) == len(t) and u[:lead] == t[:lead]]
        fixed = [x != "<*>" and sum(n[u] for u in same if u[k] == x) >= min_docs for k, x in enumerate(t)]
        template[t] = tuple(x if f else "<*>" for x, f in zip(t, fixed, strict=True)) if sum(fixed) >= constant * len(t) else t
    total = {}
    for t, m in template.items():
        total[m] = total.get(m, 0) + n[t]
    return [[k for k, t in enumerate(d) if t in template and total[template[t]] >= min_docs] for d in docs]


@pytest.mark.parametrize("size", [100_000, 1])
def test_report_is_brute_force(docs, size, monkeypatch):
    monkeypatch.setattr(line_dedup, "TASK_LINES", size)
    rows = docs.collect()
    want = sorted(str((r.doc_id, len((r.text or "").split("\n")), len(d), d)) for r, d in zip(rows, brute(rows), strict=True))
    assert sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.dropped)) for r in line_report(docs).collect()) == want


def test_drop_lines(docs):
    rows = docs.collect()
    got = drop_lines(docs)
    assert got.columns == docs.columns
    want = sorted(str((r.doc_id, r.text if not d else "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in d), r.dropped_lines)) for r, d in zip(rows, brute(rows), strict=True))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert line_report(docs.limit(0)).count() == 0 and drop_lines(docs.limit(0)).count() == 0


def test_long_passages_recur_in_two_documents(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    passage = {k: " ".join(words[k:] + words[:k] + ["once", "more"]) for k in (1, 2, 3)}  # 50 words
    short = " ".join(words[:-1] + ["short"])
    rows = [(k, f"text {k * 'x'}\n{passage[2]}\n{short}\n{passage[3] if k else passage[1]}") for k in range(2)] + [(k, passage[3]) for k in (2, 3)]
    rows += [(k, f"{passage[1].replace('once', 'twice')} again") for k in (4,)]
    got = {r.doc_id: r.dropped for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: [1], 1: [1, 3], 2: [0], 3: [0], 4: []}


@pytest.mark.parametrize("size", [1, 3, 10])
def test_large_leaves_are_brute_force(spark, docs, size, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAF_LINES", size)
    r = random.Random(7)
    words = [f"w{chr(97 + k)}" for k in range(12)]
    # One leaf whose constants stand in lines that sort far apart: a varying fifth token, then tokens shared by few.
    spread = [(200 + k, f"all in one leaf {words[k % 12]} holds {r.choice(['this', 'that', 'rare' + words[k // 5]])} same tail of line") for k in range(60)]
    more = docs.unionByName(spark.createDataFrame([(k, x, "x") for k, x in spread], docs.schema))
    rows = more.collect()
    want = sorted(str((r.doc_id, len((r.text or "").split("\n")), len(d), d)) for r, d in zip(rows, brute(rows), strict=True))
    assert sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.dropped)) for r in line_report(more).collect()) == want


def test_a_leaf_with_a_third_of_all_lines_is_dealt_over_tasks(spark, monkeypatch):
    """Lines of one shape fill a leaf: they never meet the parser of whole leaves, tokens that all of them have are dealt, and the result is the same."""
    rows = [(k, "\n".join([f"common head of the line w{k % 50} then x{chr(97 + k % 26) * (k % 9)} end", f"other {k % 7} shape of a line", "a b c d"])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted((r.doc_id, tuple(r.dropped)) for r in line_dedup.line_report(docs).collect())
    joins, join = [], line_dedup.spread_join

    def spread(many, few, on, by, *how, **named):
        joins.append(tuple(on))
        return join(many, few, on, by, *how, **named)

    monkeypatch.setattr(line_dedup, "spread_join", spread)
    monkeypatch.setattr(line_dedup, "LEAF_LINES", 20)
    parse = line_dedup._parse

    def small_only(*how):
        def run(batches):
            for out in parse(*how)(batches):
                if any(x is not None for x in out.column("tokens").to_pylist()):
                    raise ValueError("a large leaf was read by one task")
                yield out

        return run

    monkeypatch.setattr(line_dedup, "_parse", small_only)
    assert sorted((r.doc_id, tuple(r.dropped)) for r in line_dedup.line_report(docs).collect()) == want
    assert ("leaf", "at", "token") in joins
