"""Finding and replacing personal information in tables of texts.

Each text is judged on its own in Arrow batches, whole, however long; nothing is shuffled, so hot conversations and
copies cost what their rows cost (texts repeated within a task are judged once).

Defined results: null and empty texts hold nothing and stay as they are; each row counts, copies and old versions too;
null array members stay null; an empty table gives no rows; other columns are kept by ``redact``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from threadlake.llm.pii.model import MODEL, load
from threadlake.llm.pii.spans import TYPES, Segment
from threadlake.llm.pii.view import View, replace

ALL = frozenset(TYPES)
#: In a field that holds a display name, that name itself is no finding.
DISPLAY = ALL - {"name"}
#: Texts remembered per task, and the longest text that is remembered.
_REMEMBERED, _SHORT = 20_000, 400


def _judge(path: str, text: str, kinds: frozenset[str]) -> tuple[View, list[Segment]]:
    view = View(text)
    return view, load(path).find(view.text, kinds)


@lru_cache(maxsize=_REMEMBERED)
def _types_short(path: str, text: str, kinds: frozenset[str]) -> tuple[str, ...]:
    return tuple(sorted({s.kind for s in _judge(path, text, kinds)[1]}))


def types_in(text: str | None, kinds: frozenset[str] = ALL, path: str = str(MODEL)) -> tuple[str, ...]:
    if not text:
        return ()
    return _types_short(path, text, kinds) if len(text) <= _SHORT else tuple(sorted({s.kind for s in _judge(path, text, kinds)[1]}))


@lru_cache(maxsize=_REMEMBERED)
def _redacted_short(path: str, text: str, kinds: frozenset[str]) -> str:
    return _redacted(path, text, kinds)


def _redacted(path: str, text: str, kinds: frozenset[str]) -> str:
    view, found = _judge(path, text, kinds)
    return replace(text, view, [(s.start, s.end, s.kind) for s in found]) if found else text


def redact_text(text: str | None, kinds: frozenset[str] = ALL, path: str = str(MODEL)) -> str | None:
    if not text:
        return text
    return _redacted_short(path, text, kinds) if len(text) <= _SHORT else _redacted(path, text, kinds)


def _found(key: str, fields: list[tuple[str, str, frozenset[str]]], path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(key).to_pylist()
        out: list[tuple[str, object, str]] = []
        for column, name, kinds in fields:
            for k, value in zip(keys, batch.column(column).to_pylist(), strict=True):
                if isinstance(value, list):
                    kinds_found = sorted({t for v in value if v for m, own in (("n", kinds - {"name"}), ("r", kinds)) for t in types_in(v.get(m), own, path)})
                else:
                    kinds_found = types_in(value, kinds, path)
                out += [(name, k, t) for t in kinds_found]
        names, ids, types = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.int64()), pa.array(types, pa.string())], names=["field_name", "row_no", "pii_type"])


def find(df: DataFrame, fields: Sequence[tuple[str, frozenset[str]]], key: str = "row_no", path: str = str(MODEL)) -> DataFrame:
    """field_name, row_no, pii_type: one row per record, field and type. A field may be a string or an attendee list (members n and r)."""
    plan = [(c, c, kinds) for c, kinds in fields]
    rows = df.select(key, *[c for c, _ in fields])
    return rows.mapInArrow(lambda b: _found(key, plan, path, b), "field_name string, row_no long, pii_type string")


def _replaced(fields: dict[str, frozenset[str]], path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = []
        for i, field in enumerate(batch.schema):
            if field.name not in fields:
                columns.append(batch.column(i))
                continue
            kinds, values = fields[field.name], batch.column(i).to_pylist()
            if pa.types.is_list(field.type):
                done = [None if v is None else [None if a is None else a | {"n": redact_text(a.get("n"), kinds - {"name"}, path), "r": redact_text(a.get("r"), kinds, path)} for a in v] for v in values]
            else:
                done = [redact_text(v, kinds, path) for v in values]
            columns.append(pa.array(done, field.type))
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def redact(df: DataFrame, fields: Sequence[tuple[str, frozenset[str]]], path: str = str(MODEL)) -> DataFrame:
    """The same rows and columns with typed placeholders in the fields."""
    wanted = dict(fields)
    return df.mapInArrow(lambda b: _replaced(wanted, path, b), df.schema)
