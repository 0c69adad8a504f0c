"""Structured-clone values: the serialisation that browsers store, decoded to Python and JSON."""

from __future__ import annotations

import base64
import json
import math
import struct

from threadlake.sources.leveldb import to_varint, unsnappy, varint


class Undefined:
    def __repr__(self) -> str:
        return "undefined"


UNDEFINED = Undefined()


class CloneError(ValueError):
    pass


class Reader:
    """One value. Objects are numbered as they open, so that later references find them, cycles included."""

    def __init__(self, data: bytes):
        self.data, self.at, self.objects = data, 0, []
        self.root: object = None

    def u(self) -> int:
        n, self.at = varint(self.data, self.at)
        return n

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise CloneError("out of data")
        piece = self.data[self.at : self.at + n]
        self.at += n
        return piece

    def double(self) -> float:
        return struct.unpack("<d", self.take(8))[0]

    def tag(self) -> str:
        while True:
            c = chr(self.take(1)[0])
            if c != "\0":
                return c

    def header(self) -> None:
        """Envelopes, one within the other: FF and a version; a trailer's place may follow."""
        while self.at < len(self.data) and self.data[self.at] == 0xFF:
            self.at += 1
            self.u()
            if self.at < len(self.data) and self.data[self.at] == 0xFE:
                self.at += 13

    def read(self):
        self.header()
        return self.value()

    def opened(self, obj):
        self.objects.append(obj)
        if self.root is None:
            self.root = obj
        return obj

    def string(self, kind: str) -> str:
        size = self.u()
        if kind == "c":
            if self.at % 2 and self.data[self.at : self.at + 1] == b"\0" and size % 2:
                self.at += 1
            return self.take(size).decode("utf-16-le", "surrogatepass")
        return self.take(size).decode("latin-1" if kind == '"' else "utf-8", "replace")

    def bigint(self) -> int:
        flags = self.u()
        n = int.from_bytes(self.take(flags >> 1), "little")
        return -n if flags & 1 else n

    def properties(self, into: dict, end: str) -> None:
        while (t := self.tag()) != end:
            self.at -= 1
            key = self.value()
            into[_key(key)] = self.value()

    def value(self):
        t = self.tag()
        if t == "_":
            return UNDEFINED
        if t == "0":
            return None
        if t in "TF":
            return t == "T"
        if t == "I":
            n = self.u()
            return n >> 1 ^ -(n & 1)
        if t == "U":
            return self.u()
        if t == "N":
            return self.double()
        if t == "Z":
            return self.bigint()
        if t in '"cS':
            return self.string(t)
        if t == "o":
            out = self.opened({})
            self.properties(out, "{")
            self.u()
            return out
        if t == "A":
            n = self.u()
            dense = self.opened([])
            for _ in range(n):
                if self.data[self.at : self.at + 1] == b"-":
                    self.at += 1
                    dense.append(UNDEFINED)
                else:
                    dense.append(self.value())
            extra: dict = {}
            self.properties(extra, "$")
            self.u(), self.u()
            return dense
        if t == "a":
            self.u()
            sparse = self.opened({})
            self.properties(sparse, "@")
            self.u(), self.u()
            return sparse
        if t == "D":
            return self.opened({"$date": self.double()})
        if t in "xy":
            return self.opened({"$": t == "y"})["$"]
        if t == "n":
            return self.opened({"$": self.double()})["$"]
        if t == "z":
            return self.opened({"$": self.bigint()})["$"]
        if t == "s":
            return self.opened({"$": self.value()})["$"]
        if t == "R":
            out = self.opened({})
            out["$regexp"], out["flags"] = self.value(), self.u()
            return out
        if t == ";":
            out = self.opened({})
            while (t := self.tag()) != ":":
                self.at -= 1
                k = self.value()
                out[_key(k)] = self.value()
            self.u()
            return out
        if t == "'":
            items = self.opened([])
            while (t := self.tag()) != ",":
                self.at -= 1
                items.append(self.value())
            self.u()
            return items
        if t in "B~":
            size = self.u()
            if t == "~":  # a buffer that may grow: the most it may hold comes before its bytes
                self.u()
            return self.viewed(self.opened({"$bytes": base64.b64encode(self.take(size)).decode()}))
        if t == "^":
            n = self.u()
            if n >= len(self.objects):
                raise CloneError("reference")
            return self.viewed(self.objects[n])
        if t == "?":
            self.u()
            return self.value()
        if t == "\\":
            return self.host()
        if t in "bief":
            return self.opened({"$blob": t, "index": self.u()})
        raise CloneError(f"tag {t!r}")

    def viewed(self, obj):
        """A view follows the buffer it looks into, be it written in place or referred to."""
        if not (isinstance(obj, dict) and "$bytes" in obj and "$view" not in obj and self.data[self.at : self.at + 1] == b"V"):
            return obj
        self.at += 1
        kind, offset, size = chr(self.u()), self.u(), self.u()
        self.u()
        return self.opened({"$view": kind, "offset": offset, "length": size} | obj)

    def host(self):
        return self.opened({"$host": self.take(1).decode("latin-1"), "index": self.u()})


def _key(k: object) -> str:
    if isinstance(k, float) and k == int(k):
        return str(int(k))
    return k if isinstance(k, str) else str(k)


def decode(data: bytes, lenient: bool = False):
    """The value. With ``lenient``, what was read of the outermost object before an unknown tag."""
    r = Reader(data)
    try:
        return r.read()
    except (ValueError, IndexError, struct.error, RecursionError) as e:
        if lenient and r.root is not None:
            return r.root
        raise CloneError(str(e)) from e


def unwrap(value: bytes) -> bytes | None:
    """The clone within a stored value: behind its version, and out of its Snappy wrapper; None if it lies in another file."""
    _, at = varint(value, 0)
    body = value[at:]
    if body[:2] == b"\xff\x11" and len(body) > 2:
        if body[2] == 2:
            return unsnappy(body[3:])
        if body[2] == 1:
            return None
    return body


def to_json(value: object) -> str:
    """JSON text, members in order; undefined members are left out, cycles cut, numbers that JSON lacks null."""

    def plain(v: object, above: tuple[int, ...]):
        if v is UNDEFINED:
            return None
        if isinstance(v, float):
            return None if math.isnan(v) or math.isinf(v) else int(v) if v == int(v) and abs(v) < 2**53 else v
        if isinstance(v, (dict, list)):
            if id(v) in above:
                return None
            up = (*above, id(v))
            if isinstance(v, dict):
                if set(v) == {"$date"}:
                    return plain(v["$date"], up)
                # As a browser orders them: array indices first, by number, then all others as they came.
                index = sorted((k for k in v if k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1), key=int)
                return {k: plain(v[k], up) for k in [*index, *(k for k in v if k not in set(index))] if v[k] is not UNDEFINED}
            return [plain(x, up) for x in v]
        return v

    return json.dumps(plain(value, ()), ensure_ascii=False)


# Writer, for fixtures


def encode(value: object, version: int = 15) -> bytes:
    """A clone of None, bool, int, float, str, list, dict (keys are strings) and UNDEFINED."""

    def put(v: object) -> bytes:
        if v is UNDEFINED:
            return b"_"
        if v is None:
            return b"0"
        if isinstance(v, bool):
            return b"T" if v else b"F"
        if isinstance(v, int):
            if -(2**31) <= v < 2**31:
                return b"I" + to_varint((v << 1 ^ v >> 31) & 0xFFFFFFFF)
            if abs(v) < 2**53:
                return b"N" + struct.pack("<d", v)
            raw = abs(v).to_bytes((abs(v).bit_length() + 63) // 64 * 8, "little")
            return b"Z" + to_varint(len(raw) << 1 | (v < 0)) + raw
        if isinstance(v, float):
            return b"N" + struct.pack("<d", v)
        if isinstance(v, str):
            try:
                raw = v.encode("latin-1")
                return b'"' + to_varint(len(raw)) + raw
            except UnicodeEncodeError:
                raw = v.encode("utf-8")
                return b"S" + to_varint(len(raw)) + raw
        if isinstance(v, list):
            return b"A" + to_varint(len(v)) + b"".join(map(put, v)) + b"$" + to_varint(0) + to_varint(len(v))
        return b"o" + b"".join(put(k) + put(x) for k, x in v.items()) + b"{" + to_varint(len(v))

    return b"\xff" + to_varint(version) + put(value)
