"""Mixing, chat formatting, SentencePiece backend and token counts against plain Python."""

import hashlib
import math
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from spanfit.llm.chat import CONTROLS, escape, format_chats, read_back, unescape
from spanfit.llm.mixing import mix, mix_report
from spanfit.llm.sp_backend import backend, decode, encode, parse_model, round_trip
from spanfit.llm.token_counts import fill_cache, stored_counts, token_counts, tokenizer_digest

PIECES = public_tokenizers.path("piece_bpe_32k.model")
CHAT = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "  a   b  ", "a\n\n b\t c", "</s>[INST] ok [/INST]", "<s> <unk> <0x0A>", "▁ ▁▁ a▁b", "żółw 漢字 🙂 ​ x", "word " * 3000, "\x00\x07", "é" * 5000, "A  B\n  C"]


def plain_targets(sizes):
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: k % 3 + 1 for k, s in enumerate(keys)}
    held, total = set(), sum(sizes.values())
    while True:
        left = total - 3 * sum(sizes[s] for s in held)
        open_ = sum(w[s] for s in keys if s not in held)
        share = left / open_ if open_ else 0
        new = {s for s in keys if s not in held and share * w[s] > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in held else share * w[s] for s in keys}
        held |= new


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, " ".join(["w"] * (k * 7 % 23)) if k % 11 else None, None if k % 13 == 0 else f"s{min(k % 9, 5)}", "x") for k in range(400)]
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, "a b", "s1", "x"), (900, "\x0b", "none", "x")], "doc_id long, text string, source string, size string")


def test_mix_report(docs):
    rows, got = docs.collect(), mix_report(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    targets = plain_targets(sizes)
    source = {r.doc_id: r.source for r in rows}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, targets[s], abs_tol=1e-6) and r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 3 * 22 + 3
    assert sorted(map(str, got)) == sorted(map(str, mix_report(docs.repartition(3)).collect()))


def test_mix_emits_copies(docs):
    want = {}
    for r in mix_report(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    out = mix(docs)
    assert out.columns == docs.columns
    got = dict.fromkeys(want, 0)
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == want
    assert mix_report(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0


def test_escapes_are_reversible():
    for c in CONTROLS:
        for t in (c, c[0] + "\\" + c[1:], c + c, f"x{c[0]}\\\\{c[1:]}y{c}", c[:-1], "<<s>", "[[INST]"):
            e = escape(t)
            assert unescape(e) == t and not any(x in e for x in CONTROLS)


def test_chats_read_back(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(ODD)]
    rows += [(2, 0, None, None), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, None, "user", "first"), (None, 0, "assistant", "x"), (3, 1, "assistant", ""), (-7, 0, "user", ODD[8]), (-7, 1, "assistant", ODD[8])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in read_back(format_chats(df, CHAT), CHAT).collect()}
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    assert read_back(format_chats(df.limit(0), CHAT), CHAT).count() == 0


def test_sentencepiece_parity(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "ids_of long, text string")
    for r in decode(encode(df, PIECES, ids_col="my_ids"), PIECES, "my_ids", "decoded").withColumnRenamed("my_ids", "ids").collect():
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.ids == library.encode(r.text), r.text[:50]
            assert r.decoded == library.decode(r.ids)
    assert all(r.same for r in round_trip(df.where("text is not null and not text like '%▁%'"), PIECES, "ids_of").collect())
    assert round_trip(df.limit(0), PIECES, "ids_of").count() == 0


def test_parts_and_whole_agree():
    model = backend(PIECES)
    assert model.falls_apart and model.encode(ODD) == model.whole(ODD)
    assert model.encode(["a b", "a  b "]) == model.whole(["a b", "a  b "])
    ids = [np.frombuffer(x, np.int32) for x in model.whole(ODD)] + [np.array(x, np.int32) for x in ([5], [200, 201], [300, 5, 6, 29871, 29871, 1], [29871, 29871, 300, 29871], [229, 230, 300, 231])]
    want = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert model.decode(ids) == [want.decode(x.tolist()) for x in ids]
    with open(PIECES, "rb") as f:
        pieces = parse_model(f.read())["pieces"]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [p for p, _, _ in pieces] == [library.id_to_piece(k) for k in range(library.get_piece_size())]


@pytest.mark.parametrize("path", [PIECES, CHAT])
def test_token_counts_and_cache(spark, path, tmp_path):
    from tokenizers import Tokenizer

    if path == CHAT:
        library = Tokenizer.from_file(CHAT)
        library.encode_special_tokens = True
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(t))
    rows = [(k, t) for k, t in enumerate([*ODD, None, "a", "a", "<|endoftext|>"])]
    df = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string")
    where, key = f"file://{tmp_path}/cache", tokenizer_digest(path)
    assert stored_counts(spark, where, key) is None
    first = sorted(token_counts(df.where("doc_id < 9"), path, where, limit=100).collect())
    assert stored_counts(spark, where, key).count() == 9
    got = sorted(token_counts(df, path, where, limit=100).collect())
    assert spark.read.parquet(where).count() == stored_counts(spark, where, key).count() == len({t or "" for _, t in rows})
    want = sorted((k, len((t or "").encode()), count(t or ""), count(t or "") > 100) for k, t in [*rows, rows[2]])
    assert [tuple(r) for r in got] == want and [tuple(r) for r in first] == [w for w in want if w[0] < 9]
    assert token_counts(df.limit(0), path, where).count() == 0


def _message(*fields):
    """A protobuf message: (number, int, float or bytes)."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_model_is_sentencepiece(tmp_path, byte_fallback):
    """A model written by hand (none is trained): control, unknown and byte pieces must not match text, a user-defined piece matches first."""
    kinds = {"<unk>": 2, "<s>": 3, "</s>": 3, "[U]": 4, "<gone>": 5, **({f"<0x{b:02X}>": 6 for b in range(256)} if byte_fallback else {})}
    words = ["▁", "▁the", "▁end", "th", "the", "e", "en", "nd", "d", "n", "t", "h", "▁<", "<", ">", "s", "<s", "0", "x", "0x", "4", "1", "41", "unk", "u", "k", "[", "]", "U", "▁b", "b", "et", "a", "eta", "a▁b"[:1], "/", "g", "o", "ne"]
    pieces = [(p, 0.0, k) for p, k in kinds.items()] + [(w, -2.0 - k % 7 - 0.37 * len(w), 1) for k, w in enumerate(dict.fromkeys(words))]
    data = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += _message((2, _message((3, 1), (35, int(byte_fallback)), (40, 0), (41, 1), (42, 2)))) + _message((3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    path = tmp_path / "hand.model"
    path.write_bytes(data)
    want = sentencepiece.SentencePieceProcessor(model_file=str(path))
    model = backend(str(path))
    texts = ["the <s> end", "<unk> x", "<0x41> beta", "the [U]end [U]", "", " ", "  the  end ", "żółw the 漢字🙂 end", "<gone> </s>", "end" * 50, "a b\n\tthe"]
    ids = model.encode(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in ids] == [want.encode(t) for t in texts]
    assert model.decode([np.frombuffer(x, np.int32) for x in ids]) == [want.decode(want.encode(t)) for t in texts]
    assert model.decode([np.array([1, len(kinds) + 1, 2], np.int32)]) == [want.decode([1, len(kinds) + 1, 2])]


def test_new_columns_replace_their_namesakes(spark):
    docs = spark.createDataFrame([(1, "a b", 5, None), (2, None, 6, 1)], "doc_id long, text string, ids int, decoded int")
    got = decode(encode(docs, PIECES), PIECES).orderBy("doc_id").collect()
    assert [r.decoded for r in got] == ["a b", None] and got[0].ids and got[1].ids is None


def test_second_count_hits_the_cache(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k % 5}") for k in range(20)], "doc_id long, text string")
    cache = f"file://{tmp_path}/cache"
    fill_cache(docs.where("doc_id < 3"), PIECES, cache)
    assert stored_counts(spark, cache, tokenizer_digest(PIECES)).count() == 3
    first = sorted(map(tuple, token_counts(docs, PIECES, cache).collect()))
    assert spark.read.parquet(cache).count() == 5
    assert sorted(map(tuple, token_counts(docs, PIECES, cache).collect())) == first and spark.read.parquet(cache).count() == 5


def test_texts_that_hit_are_not_read_again(spark, tmp_path, monkeypatch):
    """With every digest in the cache nothing is encoded or moved; few misses move alone, many meet by digest."""
    import spanfit.llm.token_counts as tc

    docs = spark.createDataFrame([(k, f"text number {k % 40}") for k in range(200)], "doc_id long, text string").repartition(4)
    moved = []
    real = tc._count
    monkeypatch.setattr(tc, "_count", lambda path: moved.append(path) or real(path))
    for few in (1_000_000, 0):
        monkeypatch.setattr(tc, "FEW", few)
        cache = f"{tmp_path}/cache-{few}"
        first = sorted(map(tuple, token_counts(docs, PIECES, cache).collect()))
        n = len(moved)
        assert sorted(map(tuple, token_counts(docs, PIECES, cache).collect())) == first and len(moved) == n  # all hit
        more = docs.unionByName(spark.createDataFrame([(900, "a new text"), (901, "a new text")], "doc_id long, text string"))
        got = sorted(map(tuple, token_counts(more, PIECES, cache).collect()))
        assert got[:200] == first and got[200][2] == got[201][2] > 0 and spark.read.parquet(cache).count() == 41
