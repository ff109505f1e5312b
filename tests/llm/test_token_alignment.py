"""Alignment of two tokenizers against a plain reading, token by token."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from spanfit.llm.token_alignment import Aligner, align_chunks, aligner, alignment_report, byte_values, group_products, overlaps, pair_counts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "the cat sat on the mat", "the cat sat on the mat", None, "", " ", "  two  spaces ", "a \n b\n\n c", "tab\tand\nline  x", "end ", "\n", "x" * 3000, "marker ▁ inside",
    "<|endoftext|> </s> <s> <0x41> [INST]", "naïve café déjà-vu 東京都 🙂🙂 ﬁ ①", "it's 12345 don't; (ok)...", "zero\0byte", "é ​　wide", " lead", "Unbelievable counterrevolutionaries internationalization", "a", "the",
]


def tokens(text):
    """Ids and bytes of both, straight from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    value = byte_values()
    e = t.encode(" " + text, add_special_tokens=False)
    ids = s.encode(text)
    pieces = [s.id_to_piece(k) for k in ids]
    return e.ids, [bytes(value[c] for c in x) for x in e.tokens], ids, [bytes([int(p[3:5], 16)]) if s.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(ids, pieces, strict=True)]


def plain(texts):
    found = []
    for text in texts:
        a, a_bytes, b, b_bytes = tokens(text) if text else ([], [], [], [])
        want = b" " + (text or "").encode()
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            found.append(([], [], [], []))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(a_ends[i] - len(a_bytes[i]), b_ends[j] - len(b_bytes[j])) < min(a_ends[i], b_ends[j])]
        shared = [0, *sorted(set(a_ends) & set(b_ends))]
        groups = [([x for x, e in zip(a, a_ends, strict=True) if lo < e <= hi], [x for x, e in zip(b, b_ends, strict=True) if lo < e <= hi]) for lo, hi in zip(shared, shared[1:], strict=False)]
        found.append((a, b, groups, links))
    count = Counter(p for *_, links in found for p in set(links))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    rows = []
    for k, (a, b, groups, links) in enumerate(found):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((k, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return rows, count


@pytest.mark.parametrize(("chunk_links", "part"), [(3_000_000, 256), (40, 3)])
def test_report_is_plain_reading(spark, chunk_links, part):
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_a int").repartition(3)
    got = alignment_report(docs, A, B, chunk_links=chunk_links, part=part)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want, count = plain(TEXTS)
    assert sorted(map(tuple, got.collect())) == want
    rows = pair_counts(align_chunks(docs, A, B, chunk_links=chunk_links, part=part)).collect()
    assert {(r.a_id, r.b_id): r.n for r in rows} == dict(count)


def test_ids_may_be_null_and_tables_empty(spark):
    docs = spark.createDataFrame([(None, "the cat"), (None, None), (1, "the cat")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in alignment_report(docs, A, B).collect()) == [(0, 0, 0), (0, 2, 4), (1, 2, 4)]
    assert alignment_report(docs.limit(0), A, B).collect() == []
    assert {r.count_sum for r in alignment_report(docs.where("text is null"), A, B).collect()} == {0}


def test_documents_of_the_sample_equal_whole_texts(spark):
    """Texts taken apart into units give what whole texts give."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    model = aligner(A, B)
    counts, digests, text, pair, times = model.documents(texts)
    some, _, pairs, spelled = model.align(texts)
    assert np.array_equal(counts, some) and digests == [hashlib.sha256(s[:-1].encode()).hexdigest() if s else "" for s in spelled]
    want = Counter(zip(np.repeat(np.arange(len(texts)), some[:, 3]).tolist(), pairs.tolist(), strict=True))
    assert dict(zip(zip(text.tolist(), pair.tolist(), strict=True), times.tolist(), strict=True)) == dict(want)


def test_overlaps_and_products():
    a_ends, b_ends = np.array([2, 3, 7, 9]), np.array([1, 3, 8, 9])
    a, b, closes = overlaps(a_ends, b_ends)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 2), (3, 3)] and closes.tolist() == [False, False, True, False, False, True]
    found = [(x, y) for i, j in group_products(np.array([10, 11, 12, 13]), np.array([20, 21, 22, 23]), a_ends, b_ends) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
    assert found == [(x, y) for g in (((10, 11), (20, 21)), ((12, 13), (22, 23))) for x in g[0] for y in g[1]]
    assert list(group_products(*[np.zeros(0, np.int64)] * 4)) == []


def test_units_table_is_emptied_when_full(monkeypatch):
    monkeypatch.setattr("spanfit.llm.token_alignment.UNITS", 5)
    model = Aligner(A, B)
    first = model.documents(["one two three four", "five six seven eight"])
    assert model.documents(["nine ten", "one two three four"])[1][1] == first[1][0]
