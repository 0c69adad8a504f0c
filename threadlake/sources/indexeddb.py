"""Object stores within LevelDB: key prefixes, name catalogs and records."""

from __future__ import annotations

from typing import NamedTuple

from threadlake.sources.leveldb import Entry, to_varint, varint

DB_NAME, STORE_META = 0xC9, 0x32
DATA_INDEX = 1


class Prefix(NamedTuple):
    db_id: int
    os_id: int
    index_id: int
    size: int


def prefix(key: bytes) -> Prefix:
    """The first byte holds the lengths of three little-endian numbers, as 3, 3 and 2 bits."""
    b = key[0]
    sizes = ((b >> 5 & 7) + 1, (b >> 2 & 7) + 1, (b & 3) + 1)
    at, out = 1, []
    for n in sizes:
        if at + n > len(key):
            raise ValueError("key prefix")
        out.append(int.from_bytes(key[at : at + n], "little"))
        at += n
    return Prefix(*out, at)


def to_prefix(db_id: int, os_id: int, index_id: int) -> bytes:
    parts = [n.to_bytes(max(1, (n.bit_length() + 7) // 8), "little") for n in (db_id, os_id, index_id)]
    return bytes([len(parts[0]) - 1 << 5 | len(parts[1]) - 1 << 2 | len(parts[2]) - 1]) + b"".join(parts)


def _text(data: bytes, at: int) -> tuple[str, int]:
    n, at = varint(data, at)
    return data[at : at + 2 * n].decode("utf-16-be", "replace"), at + 2 * n


def to_text(s: str) -> bytes:
    raw = s.encode("utf-16-be")
    return to_varint(len(raw) // 2) + raw


def describe(e: Entry) -> dict:
    """Columns of an entry: rec_kind ('record', 'db_name', 'store_name' or 'other'), ids, and the name of a catalog row."""
    out = {"rec_kind": "other", "db_id": None, "os_id": None, "index_id": None, "name": None}
    try:
        p = prefix(e.key)
        out |= {"db_id": p.db_id, "os_id": p.os_id, "index_id": p.index_id}
        rest = e.key[p.size :]
        if (p.db_id, p.os_id, p.index_id) == (0, 0, 0) and rest[:1] == bytes([DB_NAME]):
            _, at = _text(rest, 1)
            name, _ = _text(rest, at)
            out |= {"rec_kind": "db_name", "name": name, "db_id": int.from_bytes(e.value, "little") if e.value else None}
            if e.value:
                out["db_id"] = varint(e.value, 0)[0]
        elif p.db_id and p.os_id == 0 and p.index_id == 0 and rest[:1] == bytes([STORE_META]):
            store, at = varint(rest, 1)
            if rest[at : at + 1] == b"\0":
                out |= {"rec_kind": "store_name", "os_id": store, "name": e.value.decode("utf-16-be", "replace") if e.value else None}
        elif p.index_id == DATA_INDEX:
            out["rec_kind"] = "record"
    except (ValueError, IndexError):
        pass
    return out
