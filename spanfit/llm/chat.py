"""Chat formatting by token-level assembly.

Roles and texts are encoded separately, as ordinary text (special strings in them are never special), and spliced
between reserved ids that lie above the tokenizer's own: TURN role BODY text END, turn after turn. The loss mask comes
from the segments' lengths: +1 where an assistant text begins, -1 where it ends, summed from the left. Beside the ids
stands the same conversation as a string, with the control strings of CONTROLS for the reserved ids; a control string
that occurs in a text gets a backslash after its first character (and those that have backslashes there get one more),
which `unescape` takes back. The ids hold the escaped texts too, so either form reads back to the same turns.

Turns are encoded where they are scanned; only then are a conversation's turns brought together, in order of (turn, role,
text), and assembled one conversation at a time. A conversation is one training example and so one row.

Defined results: null role or text is empty; null conversation ids form one conversation; rows with equal turn numbers
stand in order of role and text; repeated rows are repeated turns; an empty text gives an empty segment; an empty table
gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfit.llm.common import small_batches

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that mean something to this template or to common chat templates; none may stand unescaped in a text.
CONTROLS = (TURN, BODY, END, "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
_RAW = re.compile("|".join(f"{re.escape(c[0])}(?=(\\\\*){re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\(?=(\\\\*){re.escape(c[1:])})" for c in CONTROLS))

_TURNS = "conv_id long, turn long, role string, text string, role_ids array<int>, text_ids array<int>"
_CHAT = "conv_id long, input_ids array<int>, loss_mask array<tinyint>, formatted string"
_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """A backslash after the first character of every control string, and of those escaped before."""
    return _RAW.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], text)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def reserved(path: str) -> dict[str, int]:
    """Ids of TURN, BODY and END: the first ones above the tokenizer's."""
    return {c: _tokenizer(path).get_vocab_size() + k for k, c in enumerate((TURN, BODY, END))}


def _ints(lists: list, of: pa.DataType) -> pa.Array:
    """A list array from numpy arrays."""
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, of))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            ids = {}
            for name in ("role", "text"):
                found = t.encode_batch([escape(x) for x in b.column(name).to_pylist()], add_special_tokens=False)
                ids[name] = _ints([np.array(e.ids, np.int32) for e in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, ids["role"], ids["text"]], names=[*b.schema.names, "role_ids", "text_ids"])

    return run


def assemble(turns: list[tuple], at: dict[str, int]) -> tuple[np.ndarray, np.ndarray, str]:
    """Ids, mask and string of one conversation, from (role, text, role_ids, text_ids) in order."""
    segments, learnt, string = [], [], []
    for role, text, role_ids, text_ids in turns:
        segments += [[at[TURN]], role_ids, [at[BODY]], text_ids, [at[END]]]
        learnt += [0, 0, 0, role == "assistant", 0]
        string += [TURN, escape(role), BODY, escape(text), END]
    ends = np.cumsum([len(s) for s in segments])
    on = np.array(learnt, bool)
    steps = np.zeros(int(ends[-1]) + 1, np.int32)
    np.add.at(steps, ends[on] - np.array([len(s) for s in segments])[on], 1)
    np.add.at(steps, ends[on], -1)
    return np.concatenate([np.asarray(s, np.int32) for s in segments]), np.cumsum(steps)[:-1].astype(np.int8), "".join(string)


def _assemble(at: dict[str, int]):
    def out(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), _ints([d[1] for d in done], pa.int32()), _ints([d[2] for d in done], pa.int8()), pa.array([d[3] for d in done], pa.string())], names=["conv_id", "input_ids", "loss_mask", "formatted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, done, held = None, [], [], 0
        for b in batches:
            role_ids, text_ids = ([b.column(c)[i].values.to_numpy() for i in range(b.num_rows)] for c in ("role_ids", "text_ids"))
            for conv, *turn in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), role_ids, text_ids, strict=True):
                if turns and conv != now:
                    done.append((now, *assemble(turns, at)))
                    held += len(done[-1][1])
                    turns = []
                    if held > 1_000_000:
                        yield out(done)
                        done, held = [], 0
                now = conv
                turns.append(tuple(turn))
        if turns:
            done.append((now, *assemble(turns, at)))
        if done:
            yield out(done)

    return run


def format_chats(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conversation: conv_id, input_ids, loss_mask (1 on assistant texts' tokens), formatted."""
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.mapInArrow(_encode(tokenizer_path), _TURNS)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_assemble(reserved(tokenizer_path)), _CHAT)


def read_turns(ids: np.ndarray, mask: np.ndarray, at: dict[str, int], tokenizer) -> tuple[list[tuple[str, str]], list[str]]:
    """The (role, text) turns that the ids hold, and the texts under the mask, in order."""
    starts, bodies, ends = (np.flatnonzero(ids == at[c]) for c in (TURN, BODY, END))
    runs = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]))).reshape(-1, 2)
    spans = [*zip(starts + 1, bodies, strict=True), *zip(bodies + 1, ends, strict=True), *map(tuple, runs)]
    texts = [unescape(x) for x in tokenizer.decode_batch([ids[a:b].tolist() for a, b in spans], skip_special_tokens=False)]
    n = len(starts)
    return list(zip(texts[:n], texts[n : 2 * n], strict=True)), texts[2 * n :]


def _read_back(path: str, at: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                turns, learnt = read_turns(b.column("input_ids")[i].values.to_numpy(), b.column("loss_mask")[i].values.to_numpy(), at, t)
                whole = hashlib.sha256()
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode())
                loss = "".join(learnt)
                rows.append((b.column("conv_id")[i].as_py(), len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(b.column("formatted")[i].as_py())))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def read_back(chats: DataFrame, tokenizer_path: str) -> DataFrame:
    """From format_chats' rows alone: turns and masked texts decoded, unescaped and digested."""
    return chats.mapInArrow(_read_back(tokenizer_path, reserved(tokenizer_path)), _READ)
