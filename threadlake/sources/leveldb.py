"""LevelDB files: sorted tables and write-ahead logs, read and (for tests and fixtures) written.

A damaged part never fails a load: tables skip blocks they can't read and say so (``lossy``); a log ends at its first
torn record, which is how a log that is still written ends and loses nothing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

MAGIC = 0xDB4775248B80FB57
LOG_BLOCK = 32_768
DELETE, PUT = 0, 1


class Entry(NamedTuple):
    key: bytes
    value: bytes | None
    seq: int
    op: int


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, place behind it)."""
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")


def to_varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


@lru_cache(maxsize=1)
def _crc_table() -> tuple[int, ...]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return tuple(table)


#: Bytes that are checked in step with each other in one lane.
_LANE = 128


@lru_cache(maxsize=64)
def _past_zeros(level: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``_LANE * 2**level`` zero bytes make of a register: the images of its 32 bits, and tables of the images of its four bytes."""
    if level:
        half, tables = _past_zeros(level - 1)
        bits = _looked_up(tables, half)
    else:
        table = _crc_table()
        bits = np.array([table[(1 << i) & 0xFF] ^ (1 << i) >> 8 for i in range(32)], np.uint32)
        for _ in range(_LANE.bit_length() - 1):
            bits = _looked_up(_by_bytes(bits), bits)
    return bits, _by_bytes(bits)


def _by_bytes(bits: np.ndarray) -> np.ndarray:
    tables = np.zeros((4, 256), np.uint32)
    for i in range(32):
        tables[i // 8] ^= np.where(np.arange(256) >> i % 8 & 1, bits[i], 0).astype(np.uint32)
    return tables


def _looked_up(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 0xFF] ^ tables[1][c >> 8 & 0xFF] ^ tables[2][c >> 16 & 0xFF] ^ tables[3][c >> 24]


def crc32c(data: bytes) -> int:
    """Long data is cut into lanes that are checked in step (numpy), then joined in pairs."""
    table, c, done = _crc_table(), 0xFFFFFFFF, 0
    if len(data) >= 8 * _LANE:
        lanes = len(data) // _LANE
        done = lanes * _LANE
        columns = np.ascontiguousarray(np.frombuffer(data, np.uint8, done).reshape(lanes, _LANE).T)
        wide, regs = np.array(table, np.uint32), np.zeros(lanes, np.uint32)
        regs[0] = c
        for column in columns:
            regs = wide[(regs ^ column) & 0xFF] ^ regs >> 8
        # Empty lanes before the first change nothing and make the number a power of two.
        regs = np.concatenate([np.zeros((1 << (lanes - 1).bit_length()) - lanes, np.uint32), regs])
        level = 0
        while len(regs) > 1:
            regs = _looked_up(_past_zeros(level)[1], regs[0::2]) ^ regs[1::2]
            level += 1
        c = int(regs[0])
    for b in data[done:]:
        c = table[(c ^ b) & 0xFF] ^ c >> 8
    return c ^ 0xFFFFFFFF


def mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def unmask(masked: int) -> int:
    rot = (masked - 0xA282EAD8) & 0xFFFFFFFF
    return (rot >> 17 | rot << 15) & 0xFFFFFFFF


def unsnappy(data: bytes) -> bytes:
    """A raw Snappy block, whose length stands before it."""
    size, _ = varint(data, 0)
    if size > 1 << 31:
        raise ValueError("snappy block too large")
    return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True) if size else b""


def _block(data: bytes, offset: int, size: int, check: bool) -> bytes:
    raw = data[offset : offset + size]
    trailer = data[offset + size : offset + size + 5]
    if len(raw) < size or len(trailer) < 5:
        raise ValueError("block out of bounds")
    if check and unmask(struct.unpack("<I", trailer[1:])[0]) != crc32c(raw + trailer[:1]):
        raise ValueError("block checksum")
    if trailer[0] > 1:
        raise ValueError("unknown compression")
    return unsnappy(raw) if trailer[0] else raw


def _block_entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Keys share a prefix with the key before them; restart points stand at the end."""
    end = len(block) - 4 * (struct.unpack_from("<I", block, len(block) - 4)[0] + 1)
    if end < 0:
        raise ValueError("restart array")
    at, key = 0, b""
    while at < end:
        shared, at = varint(block, at)
        own, at = varint(block, at)
        size, at = varint(block, at)
        if shared > len(key) or at + own + size > end:
            raise ValueError("block entry")
        key = key[:shared] + block[at : at + own]
        yield key, block[at + own : at + own + size]
        at += own + size


def _internal(key: bytes, value: bytes) -> Entry:
    """The last eight bytes of a key are its sequence number and operation."""
    if len(key) < 8:
        raise ValueError("short key")
    tail = int.from_bytes(key[-8:], "little")
    op = tail & 0xFF
    return Entry(key[:-8], value if op else None, tail >> 8, op)


def read_table(data: bytes) -> tuple[list[Entry], bool]:
    """(entries, lossy) of a sorted table."""
    if len(data) < 48:
        return [], True
    lossy = int.from_bytes(data[-8:], "little") != MAGIC
    found: list[Entry] = []
    try:
        footer = data[-48:]
        _, at = varint(footer, 0)
        _, at = varint(footer, at)
        offset, at = varint(footer, at)
        size, _ = varint(footer, at)
        handles = [v for _, v in _block_entries(_block(data, offset, size, check=True))]
    except (ValueError, IndexError, struct.error, pa.ArrowException):
        return [], True
    for handle in handles:
        try:
            offset, at = varint(handle, 0)
            size, _ = varint(handle, at)
            pairs = list(_block_entries(_block(data, offset, size, check=False)))
        except (ValueError, IndexError, struct.error, pa.ArrowException):
            lossy = True
            continue
        for k, v in pairs:
            if len(k) < 8:
                lossy = True
            else:
                found.append(_internal(k, v))
    return found, lossy


def log_records(data: bytes) -> Iterator[bytes]:
    """Records put together from FULL, FIRST, MIDDLE and LAST fragments."""
    at, part = 0, None
    while at + 7 <= len(data):
        left = LOG_BLOCK - at % LOG_BLOCK
        if left < 7:
            at += left
            continue
        crc, size, kind = struct.unpack_from("<IHB", data, at)
        body = data[at + 7 : at + 7 + size]
        if kind == 0 and size == 0:  # preallocated space
            at += left
            continue
        if len(body) < size or kind not in (1, 2, 3, 4) or size > left - 7 or unmask(crc) != crc32c(bytes([kind]) + body):
            return
        at += 7 + size
        if kind == 1:
            part = None
            yield body
        elif kind == 2:
            part = body
        elif part is None:
            return
        else:
            part += body
            if kind == 4:
                yield part
                part = None


def read_log(data: bytes) -> tuple[list[Entry], bool]:
    """(entries, lossy) of a log: each record is a batch whose operations count up from its sequence number."""
    found: list[Entry] = []
    for record in log_records(data):
        try:
            seq, count = struct.unpack_from("<QI", record)
            at = 12
            for i in range(count):
                op = record[at]
                size, at = varint(record, at + 1)
                key, at = record[at : at + size], at + size
                value = None
                if op == PUT:
                    size, at = varint(record, at)
                    value, at = record[at : at + size], at + size
                if at > len(record):
                    raise ValueError("batch")
                found.append(Entry(key, value, seq + i, op))
        except (ValueError, IndexError, struct.error):
            return found, True
    return found, False


# Writers


def write_log(batches: Iterable[tuple[int, list[tuple[bytes, bytes | None]]]]) -> bytes:
    """A log of batches (first sequence number, operations; a value of None deletes)."""
    out = bytearray()
    for seq, ops in batches:
        body = struct.pack("<QI", seq, len(ops))
        for k, v in ops:
            body += bytes([v is not None]) + to_varint(len(k)) + k + (to_varint(len(v)) + v if v is not None else b"")
        first = True
        while first or body:
            left = LOG_BLOCK - len(out) % LOG_BLOCK
            if left < 7:
                out += bytes(left)
                left = LOG_BLOCK
            piece, body = body[: left - 7], body[left - 7 :]
            kind = (1 if not body else 2) if first else (4 if not body else 3)
            out += struct.pack("<IHB", mask(crc32c(bytes([kind]) + piece)), len(piece), kind) + piece
            first = False
    return bytes(out)


def write_table(entries: Iterable[Entry], block_entries: int = 16, snappy: bool = True) -> bytes:
    """A sorted table; entries by key, then falling sequence number."""
    rows = sorted(entries, key=lambda e: (e.key, -e.seq))

    def block(pairs: list[tuple[bytes, bytes]], restart: int = 8) -> bytes:
        out, restarts, last = bytearray(), [], b""
        for i, (k, v) in enumerate(pairs):
            shared = 0
            if i % restart == 0:
                restarts.append(len(out))
            else:
                while shared < min(len(k), len(last)) and k[shared] == last[shared]:
                    shared += 1
            out += to_varint(shared) + to_varint(len(k) - shared) + to_varint(len(v)) + k[shared:] + v
            last = k
        restarts = restarts or [0]
        return bytes(out) + b"".join(struct.pack("<I", r) for r in restarts) + struct.pack("<I", len(restarts))

    out, index = bytearray(), []

    def add(raw: bytes, compress: bool) -> bytes:
        body = pa.compress(raw, codec="snappy", asbytes=True) if compress else raw
        handle = to_varint(len(out)) + to_varint(len(body))
        kind = bytes([compress])
        out.extend(body + kind + struct.pack("<I", mask(crc32c(body + kind))))
        return handle

    for i in range(0, len(rows), block_entries):
        part = [(e.key + (e.seq << 8 | e.op).to_bytes(8, "little"), e.value or b"") for e in rows[i : i + block_entries]]
        index.append((part[-1][0], add(block(part), snappy)))
    meta = add(block([]), False)
    idx = add(block(index, 1), False)
    footer = meta + idx
    out += footer + bytes(40 - len(footer)) + MAGIC.to_bytes(8, "little")
    return bytes(out)
