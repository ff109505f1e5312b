"""Suffix-tree scores: base scores and counts against brute force, states as distributions, whole scores against a plain model, held-out gain."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanfit.llm import suffix_tree
from spanfit.llm.suffix_tree import BITS, END, FIRST, RARE, RareStates, Tree, Words, suffix_tree_scores


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    follow = {f"w{k}": [f"w{r.randrange(40)}" for _ in range(2)] for k in range(40)}
    rows = []
    for k in range(400):
        w = [f"w{r.randrange(40)}"]
        while len(w) < r.choice([5, 60, 200]):
            w.append(r.choice(follow.get(w[-1], ["w1"])) if r.random() < 0.9 else f"W{r.randrange(400)}")
        rows.append((k, " ".join(w), "en"))
    rows += [(500, None, "x"), (501, "", "x"), (502, " \t\n", None), (None, "w1 w2", "x"), (3, rows[3][1], "en"), (503, "É é Ä ä " + "long" * 30, "x"), (504, "w1 " * 30_000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk string")


def plain(rows, share, depth, state_share, entry_share, min_state):
    """Scores by dictionaries over words, one token at a time."""
    c = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    n_all, v = sum(c.values()), len(c)
    frequent = {w for w, k in c.items() if w is not None and k >= max(2, share * n_all)}
    cls = lambda w: ("class", zlib.crc32(w.encode()[-2:]) % suffix_tree.ENDINGS)
    sym = lambda w: w if w is None or w in frequent else cls(w)
    pred = lambda w: w if w is None or w in frequent else RARE
    base = lambda w: (c[w] + 1) / (n_all + v + 1)
    root = Counter({RARE: 1 / (n_all + v + 1)})
    for w in c:
        root[pred(w)] += base(w)
    first, second = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        if held(r.doc_id):
            continue
        t = tokens(r.text)
        s = ["begin", *map(sym, t)]
        for k, w in enumerate(t):
            for d in range(1, depth + 1):
                context = tuple(s[max(0, k + 1 - d) : k + 1])
                if len(context) == d and (d == 1 or not isinstance(context[-1], tuple)):
                    first[context][pred(w)] += 1
            if k and pred(t[k - 1]) == RARE:
                second[t[k - 1],][pred(w)] += 1
                second[s[k - 1], t[k - 1]][pred(w)] += 1
    states = {}

    def test(context, counts, least, entry, below):
        total = sum(counts.values())
        listed = {x: n for x, n in counts.items() if n >= entry}
        if total < least or not listed:
            return
        q = {x: below(x) for x in listed}
        divergence = sum(n / total * math.log(n / total / q[x]) for x, n in listed.items())
        rest = 1 - sum(listed.values()) / total
        if rest > 1e-12:
            divergence += rest * math.log(rest / max(1e-12, 1 - sum(q.values())))
        if total * divergence > suffix_tree.COST * (1 + len(listed)):
            value = {x: (n - suffix_tree.DISCOUNT) / total for x, n in listed.items()}
            states[context] = value, 1 - sum(value.values())

    def p(chain, x):
        found = root[x]
        for context in chain:
            if context in states:
                value, left = states[context]
                found = left * found + value.get(x, 0)
        return found

    for d in range(1, depth + 1):
        for context, counts in first.items():
            if len(context) == d:
                test(("hot", *context), counts, max(2, state_share * n_all), max(2, entry_share * n_all), lambda x, k=context: p([("hot", *k[j:]) for j in range(len(k) - 1, 0, -1)], x))
    for d in (1, 2):
        for context, counts in second.items():
            if len(context) == d:
                w = context[-1]
                test(("rare", *context), counts, min_state, 2, lambda x, w=w, d=d: p([("hot", cls(w)), ("rare", w)][:d], x))
    scores = []
    for r in rows:
        t = tokens(r.text)
        s, score = ["begin", *map(sym, t)], 0.0
        for k, w in enumerate(t):
            last = s[k]
            if isinstance(last, tuple):
                chain = [("hot", last), ("rare", t[k - 1]), ("rare", s[k - 1], t[k - 1])]
            else:
                chain = [("hot", *s[k + 1 - d : k + 1]) for d in range(1, min(depth, k + 1) + 1)]
            score += math.log10(base(w) * p(chain, pred(w)) / root[pred(w)])
        scores.append((str(r.doc_id), round(score, 6)))
    return sorted(scores)


def test_base_scores(docs):
    rows = docs.collect()
    c = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = {}
    for r in rows:
        t = tokens(r.text)
        want[r.doc_id] = (held(r.doc_id), len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in t))
    got = suffix_tree_scores(docs).collect()
    assert sorted(str(g.doc_id) for g in got) == sorted(str(r.doc_id) for r in rows)
    for g in got:
        w = want[g.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:4] and math.isclose(g.base_score, w[4], rel_tol=1e-9)
        assert math.isfinite(g.score)
    out = [g for g in got if g.held_out]
    assert sum(g.score for g in out) > 0.8 * sum(g.base_score for g in out)
    assert suffix_tree_scores(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("chunk_texts", "task_tokens"), [(65_536, 1_000_000), (1, 1_000_000), (7, 3000), (7, 40)])
def test_scores_are_the_plain_model(docs, chunk_texts, task_tokens, monkeypatch):
    monkeypatch.setattr(suffix_tree, "CHUNK_TEXTS", chunk_texts)  # 1: over 400 chunks
    monkeypatch.setattr(suffix_tree, "TASK_TOKENS", task_tokens)  # 40: words that wait in a file
    how = dict(word_share=1 / 100, depth=3, state_share=1e-3, entry_share=1e-4, min_state=16)
    few = docs.where("doc_id is null or doc_id <> 504")
    got = sorted((str(g.doc_id), round(g.score, 6)) for g in suffix_tree_scores(few, **how).collect())
    want = plain(few.collect(), how["word_share"], 3, how["state_share"], how["entry_share"], how["min_state"])
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(math.isclose(g[1], w[1], abs_tol=2e-5) for g, w in zip(got, want, strict=True))


def test_no_training_text(spark):
    out = next(i for i in range(99) if held(i))
    g = suffix_tree_scores(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).first()
    assert (g.n_tokens, g.n_known, g.train_tokens) == (3, 0, 0) and g.base_score == 0 and math.isfinite(g.score)


def test_known_words_and_the_unseen_one_add_up_in_every_state():
    rng = np.random.default_rng(0)
    counts = {f"f{k}".encode(): int(n) for k, n in enumerate(rng.integers(500, 3000, 30))}
    rare = {f"r{k}".encode(): int(n) for k, n in enumerate(rng.integers(1, 60, 200))}
    ends = 100
    words = Words(counts, sum(counts.values()) + sum(rare.values()) + ends, len(counts) + len(rare) + 1, ends)
    tree = Tree(words.root)
    symbols = np.array([END, RARE, *range(FIRST, words.classes)])
    for depth in (1, 2, 3):
        ctx = np.unique([sum(int(x) << BITS * k for k, x in enumerate(rng.integers(FIRST, words.classes, depth))) for _ in range(25)])
        grams = np.concatenate([(ctx << BITS) | s for s in rng.choice(symbols, 5, replace=False)])
        n = rng.integers(2, 500, len(grams))
        tree.grow(ctx, np.array([n[grams >> BITS == c].sum() for c in ctx]) + 7, grams, n)
        assert len(tree.states[-1][0])
    every = [*counts.items(), *rare.items(), (None, 0)]  # None: the unseen word

    def over_words(p):
        by = dict(zip(symbols.tolist(), p, strict=True))
        base = lambda c: 10 ** words.base(np.array([c]))[0]
        total = by[END]
        for w, c in every:
            s = RARE if w is None or w in rare else words.symbol(w)
            total += base(c) * by[s] / words.root[s]
        return total

    for d in (1, 2, 3):
        for key in tree.states[d - 1][0]:
            chain = [np.full(len(symbols), key & ((1 << BITS * k) - 1)) for k in range(1, d + 1)]
            assert math.isclose(over_words(tree.probability(chain, symbols)), 1, rel_tol=1e-9)
    cls = np.array([words.classes + 5])
    keys = np.sort(np.concatenate([(b << BITS) | symbols for b in (FIRST, FIRST + 1)]))
    found = RareStates(cls, keys, rng.integers(0, 300, len(keys)), tree, 16)
    assert np.abs(found.gain).max() > 0
    for b in (FIRST, FIRST + 1):
        own = keys >> BITS == b
        floor = tree.probability([np.full(own.sum(), cls[0])], keys[own] & ((1 << BITS) - 1))
        assert math.isclose(over_words(floor * 10 ** found.gain[own]), 1, rel_tol=1e-9)
