"""Encoding of a corpus with a public byte-level BPE tokenizer, and decoding.

Texts go to the tokenizers library in Arrow batches, cut into calls of bounded size; whole texts are encoded, never
prefixes. Special tokens are off: their spellings are ordinary text, and none are added.

Defined results: a null and an empty text give an empty list; repeated rows each get their list; an empty table gives
no rows; other columns are kept by ``encode(keep=...)`` only.

Byte level: the vocabulary writes each byte as one printable character (``byte_characters``). Token offsets are kept as
characters of the text; a character split over several tokens has the same offsets in each. Decoding joins the tokens'
characters, reverses the byte table, and decodes UTF-8 once over the whole list, so split characters come together;
bytes that are no UTF-8 (a list cut within a character) become U+FFFD.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters given to the tokenizer in one call (a longer text is a call of its own).
CALL_CHARS = 500_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary file: THREADLAKE_TOKENIZERS or the installed public_tokenizers."""
    folder = os.environ.get("THREADLAKE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's cores are Spark's to share out
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=1)
def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _calls(texts: Sequence[str | None]) -> Iterator[list[str]]:
    call, size = [], 0
    for t in texts:
        if call and size + len(t or "") > CALL_CHARS:
            yield call
            call, size = [], 0
        call.append(t or "")
        size += len(t or "")
    if call:
        yield call


def _lists(values: list, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), pa.array(np.array(values, dtype=np.int32), kind))


def _encode_batches(path: str, text: str, keep: list[str], offsets: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = _tokenizer(path)
    run = t.encode_batch if offsets else t.encode_batch_fast
    for batch in batches:
        at = 0
        for call in _calls(batch.column(text).to_pylist()):
            found = run(call, add_special_tokens=False)
            ids = [e.ids for e in found]
            columns = [*batch.select(keep).slice(at, len(call)).columns, _lists(list(chain.from_iterable(ids)), [len(i) for i in ids], pa.int32())]
            names = [*keep, "ids"]
            if offsets:
                spans = [e.offsets for e in found]
                for j, name in enumerate(("starts", "ends")):
                    columns.append(_lists([s[j] for s in chain.from_iterable(spans)], [len(s) for s in spans], pa.int32()))
                    names.append(name)
            yield pa.RecordBatch.from_arrays(columns, names=names)
            at += len(call)


def encode(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None, offsets: bool = False) -> DataFrame:
    """``keep`` and ids (array<int>), with ``offsets`` also starts and ends in code points of the text.

    ``path`` must name the same vocabulary file on every executor.
    """
    path, kept = path or vocabulary(), list(keep)
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in kept), "ids array<int>", *(["starts array<int>", "ends array<int>"] if offsets else [])])
    rows = docs.select(*kept, text)
    return rows.mapInArrow(lambda b: _encode_batches(path, text, kept, offsets, b), schema)


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> dict[int, bytes]:
    back = {c: b for b, c in byte_characters().items()}
    return {i: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode() for token, i in _tokenizer(path).get_vocab().items()}


def decode_ids(ids: Sequence[int], path: str | None = None) -> str:
    table = _token_bytes(path or vocabulary())
    return b"".join(table[i] for i in ids).decode("utf-8", errors="replace")


def decode(encoded: DataFrame, keep: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep`` and text. A null list gives a null text. Texts that were null come back empty: their lists are."""
    path, kept = path or vocabulary(), list(keep)
    types = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, path) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(texts, pa.string())], names=[*kept, "text"])

    return encoded.select(*kept, "ids").mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in kept), "text string"]))
