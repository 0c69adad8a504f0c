import random

import pyarrow as pa
import pytest

from threadlake.sources import clone, indexeddb, leveldb
from threadlake.sources.datasource import LevelDbSource, canonical, copy_store, discover, probe
from threadlake.sources.leveldb import Entry


def test_crc_vector_and_varints():
    assert leveldb.crc32c(b"123456789") == 0xE3069283 and leveldb.crc32c(bytes(32)) == 0x8A9136AA
    for n in (0, 1, 127, 128, 300, 2**32, 2**56):
        assert leveldb.varint(leveldb.to_varint(n), 0)[0] == n
    assert leveldb.unmask(leveldb.mask(12345)) == 12345


def test_snappy():
    raw = b"ab" * 5000 + bytes(range(256))
    assert leveldb.unsnappy(pa.compress(raw, codec="snappy", asbytes=True)) == raw


@pytest.mark.parametrize("snappy", [True, False])
def test_table_round_trip_and_damage(snappy):
    r = random.Random(1)
    entries = [Entry(b"k%04d" % r.randint(0, 80), bytes(r.randint(0, 200)), i, 1) for i in range(200)] + [Entry(b"gone", None, 999, 0)]
    data = leveldb.write_table(entries, snappy=snappy)
    got, lossy = leveldb.read_table(data)
    assert not lossy and sorted(got) == sorted(entries)
    assert leveldb.read_table(data[:-1])[1] and leveldb.read_table(b"")[1]
    broken = bytearray(data)
    broken[0:40] = b"\xff" * 40
    some, lossy = leveldb.read_table(bytes(broken))
    assert lossy and 0 < len(some) < len(entries)


def test_log_round_trip_and_torn_end():
    batches = [(10 * i, [(b"a%d" % i, bytes(i * 997 % 70_000)), (b"b", None)]) for i in range(20)]
    data = leveldb.write_log(batches)
    got, lossy = leveldb.read_log(data)
    assert not lossy and got == [Entry(k, v, s + n, int(v is not None)) for s, ops in batches for n, (k, v) in enumerate(ops)]
    torn, lossy = leveldb.read_log(data[:-5])
    assert not lossy and torn == got[:-2]


def test_prefix():
    for ids in ((0, 0, 0), (1, 2, 1), (300, 70_000, 1)):
        p = indexeddb.prefix(indexeddb.to_prefix(*ids) + b"x")
        assert p[:3] == ids


def test_clone():
    value = {"a": 1, "b": [True, None, -5, 2.5, "é", "日本"], "big": 2**100, "neg": -(2**70), "o": {"10": 1, "2": 2, "x": clone.UNDEFINED}}
    assert clone.decode(clone.encode(value))["b"] == value["b"]
    assert clone.to_json(clone.decode(clone.encode(value))) == '{"a": 1, "b": [true, null, -5, 2.5, "é", "日本"], "big": %d, "neg": %d, "o": {"2": 2, "10": 1}}' % (2**100, -(2**70))
    raw = b"\xff\x0f" + b'o"\x01aD' + bytes(8) + b'"\x01b^\x00"\x01cR"\x01x\x03"\x01d;"\x01kI\x02:\x02"\x01e\'I\x02,\x01"\x01fB\x02hiVB\x00\x02\x00{\x06'
    out = clone.decode(raw)
    assert out["b"] is out and out["a"] == {"$date": 0.0} and out["d"] == {"k": 1} and out["e"] == [1]
    assert clone.to_json(out).startswith('{"a": 0, "b": null')
    with pytest.raises(ValueError):
        clone.decode(b"\xff\x0fo\"\x01aI\x02\"\x01b~")
    assert clone.decode(b"\xff\x0fo\"\x01aI\x02\"\x01b~", lenient=True) == {"a": 1}


def stored(value, compress):
    body = clone.encode(value)
    return leveldb.to_varint(3) + (b"\xff\x11\x02" + pa.compress(body, codec="snappy", asbytes=True) if compress else body)


def test_source_and_copy(spark, tmp_path):
    live = tmp_path / "app" / "https_x.indexeddb.leveldb"
    live.mkdir(parents=True)
    (live / "CURRENT").write_text("MANIFEST-000001\n")
    (live / "MANIFEST-000001").write_bytes(b"")
    name = indexeddb.to_prefix(0, 0, 0) + bytes([indexeddb.DB_NAME]) + indexeddb.to_text("origin") + indexeddb.to_text("chat-db")
    store = indexeddb.to_prefix(2, 0, 0) + bytes([indexeddb.STORE_META]) + leveldb.to_varint(1) + b"\0"
    rec = lambda n: indexeddb.to_prefix(2, 1, 1) + b"\x01" + bytes([n])
    (live / "000005.ldb").write_bytes(leveldb.write_table([Entry(name, leveldb.to_varint(2), 1, 1), Entry(store, "messages".encode("utf-16-be"), 2, 1), Entry(rec(1), stored({"id": "old"}, True), 3, 1), Entry(rec(2), stored({"id": "two"}, False), 4, 1)]))
    (live / "000006.log").write_bytes(leveldb.write_log([(5, [(rec(1), stored({"id": "new"}, True)), (rec(2), None)])]))
    (live / "000007.ldb").write_bytes(b"torn")
    assert discover(str(tmp_path)) == [str(live)] and probe(str(live)) and probe(str(tmp_path / "none")) is None
    copy = str(tmp_path / "copy")
    assert copy_store(str(live), copy) == (["000005.ldb", "000007.ldb", "000006.log"], False) and copy_store(str(live), copy) == ([], False)
    spark.dataSource.register(LevelDbSource)
    df = spark.read.format("threadlake_leveldb").load(copy)
    rows = df.collect()
    assert {r.name for r in rows if r.rec_kind in ("db_name", "store_name")} == {"chat-db", "messages"}
    assert {r.file: r.lossy for r in rows if r.rec_kind == "status"} == {"000005.ldb": False, "000006.log": False, "000007.ldb": True}
    recs = [r for r in rows if r.rec_kind == "record"]
    assert {(r.seq, r.op_type, r.value) for r in recs} == {(3, 1, '{"id": "old"}'), (4, 1, '{"id": "two"}'), (5, 1, '{"id": "new"}'), (6, 0, None)}
    (live / "000007.ldb").unlink()
    copy_store(str(live), copy)
    assert canonical([r.file for r in spark.read.format("threadlake_leveldb").load(copy).select("file").distinct().collect()]) == ["000005.ldb", "000006.log"]


def test_buffers_that_grow_and_views_of_references():
    view = b"V" + b"B" + bytes([1, 2, 0])
    assert clone.decode(b"\xff\x0f~\x03\x08abc") == {"$bytes": "YWJj"}
    got = clone.decode(b"\xff\x0fo\"\x01aB\x03abc\"\x01b^\x01" + view + b"{\x02")
    assert got["a"] == {"$bytes": "YWJj"} and got["b"] == {"$view": "B", "offset": 1, "length": 2, "$bytes": "YWJj"}


def test_checksums_of_long_data():
    import random

    def plain(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    r = random.Random(1)
    for n in (0, 1, 1023, 1024, 1025, 1151, 3000, 9_999):
        data = r.randbytes(n)
        assert leveldb.crc32c(data) == plain(data)
    assert leveldb.crc32c(bytes(5000)) == plain(bytes(5000))
