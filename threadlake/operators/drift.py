"""Schemas that drift between files: rescue-column ingestion and the list of changes.

Payloads are flattened to paths (members of an object joined with a dot, arrays kept whole). A target schema is then
enforced: fields it names are cast to its types; unknown fields, and values that can't be cast, are kept as JSON in the
rescue column, so no value is lost. Approved fields are promoted later, and their rescued values replayed into typed
columns without reading the files again.

The list of changes comes from ingesting each file under the schema of the store's latest earlier file: fields only the
rescue column holds are new, fields of the target without any member are gone, values of other types drifted, and
rescued values that replay into a gone field unchanged make a rename.

Defined results: payloads that are null or no JSON object have no fields (they count as records, and are rescued
whole under the path ''); repeated rows change nothing (of copies that differ, the highest raw_id counts); an object
without members is no field; null members make a field there, without a type; an empty table gives no changes.

Scale: flattening runs in Arrow batches, its aggregate per (cache, file, store, path) combines map-side; payloads meet
their target in one equi-join on (cache, store, file), which AQE splits where a file is hot; only drifted records go on,
and values are compared as sums of hashes per field, so no file, cache or pair of fields is gathered or multiplied. A
window over the files of a store in a cache holds one row per file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from functools import lru_cache, reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlake.session import cut

#: Types of leaf values, as reported.
TYPES = ("string", "number", "boolean", "array")
#: The rescue column.
RESCUED = "_rescued"


def leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    stack = [(prefix, value)]
    while stack:
        path, node = stack.pop()
        for key, v in node.items():
            if isinstance(v, dict):
                stack.append((f"{path}{key}.", v))
            else:
                yield path + key, v


def json_type(v: object) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "number"


def parse(payload: str | None) -> dict | None:
    try:
        v = json.loads(payload) if payload is not None else None
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _flatten_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    dumps = json.JSONEncoder(sort_keys=True, ensure_ascii=False).encode
    for batch in batches:
        at, paths, types, values = [], [], [], []
        for i, text in enumerate(batch.column("payload").to_pylist()):
            record = parse(text)
            if record is None:
                at.append(i), paths.append(""), types.append(None), values.append(text)
                continue
            for path, v in leaves(record):
                at.append(i), paths.append(path), types.append(json_type(v)), values.append(None if v is None else dumps(v))
        rows = batch.select(["cache_id", "file_no", "store", "rec_key", "raw_id"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(paths, pa.string()), pa.array(types, pa.string()), pa.array(values, pa.string())], names=[*rows.schema.names, "path", "type", "value"])


def flatten(raw: DataFrame) -> DataFrame:
    """One row per record and leaf: cache_id, file_no, store, rec_key, raw_id, path, type, value (JSON text)."""
    rows = raw.select("cache_id", "file_no", "store", "rec_key", "raw_id", "payload")
    schema = "cache_id long, file_no int, store string, rec_key string, raw_id long, path string, type string, value string"
    return rows.mapInArrow(_flatten_batches, schema)


def _field_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fields of each record, and their types summed per batch: what the schemas need, without values."""
    for batch in batches:
        seen: dict[tuple, None] = {}
        cols = [batch.column(c).to_pylist() for c in ("cache_id", "file_no", "store", "payload")]
        for cache, file_no, store, text in zip(*cols, strict=True):
            record = parse(text)
            seen[cache, file_no, store, "", None] = None
            for path, v in leaves(record or {}):
                seen[cache, file_no, store, path, json_type(v)] = None
        out = list(zip(*seen, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["cache_id", "file_no", "store", "path", "type"])


def schemas(raw: DataFrame) -> DataFrame:
    """The observed schema of each file and store: cache_id, store, file_no, path, types (sorted). Path '' marks the file itself."""
    rows = raw.select("cache_id", "file_no", "store", "payload").filter("cache_id is not null and file_no is not null and store is not null")
    seen = rows.mapInArrow(_field_batches, "cache_id long, file_no int, store string, path string, type string")
    return seen.groupBy("cache_id", "store", "file_no", "path").agg(F.array_sort(F.collect_set("type")).alias("types"))


FILE = ["cache_id", "store", "file_no"]


def layouts(raw: DataFrame) -> DataFrame:
    """A row per file and store: cache_id, store, file_no, own (path to types), target (``own`` of the store's latest earlier file, null for its first), following (``own`` of its next one)."""
    seen = schemas(raw)
    fields = seen.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.when(F.col("path") != "", F.struct("path", "types")))).alias("own"))  # as wide as a store's layout
    order = W.partitionBy("cache_id", "store").orderBy("file_no")
    return fields.select("*", F.lag("own").over(order).alias("target"), F.lead(F.struct("file_no", "own")).over(order).alias("after")).select(*FILE, "own", "target", F.col("after.file_no").alias("after"), F.col("after.own").alias("following"))


def _less(a: str, b: str) -> Column:
    """The paths of one layout that another lacks."""
    return F.array_except(F.map_keys(a), F.map_keys(b))


def _enforced_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record under the schema of the store's earlier file: what has to be rescued, and why; and the values it has of fields that end with its file."""
    dumps = json.JSONEncoder(sort_keys=True, ensure_ascii=False).encode
    loads = lru_cache(maxsize=4096)(json.loads)
    schema = pa.schema([("cache_id", pa.int64()), ("store", pa.string()), ("step", pa.int32()), ("side", pa.int32()), ("rec_key", pa.string()), ("raw_id", pa.int64()), (RESCUED, pa.string()), ("why", pa.map_(pa.string(), pa.string()))])
    for batch in batches:
        out: list[tuple] = []
        for cache, store, file_no, key, raw_id, text, target, after, ending, matched in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            record = dict(leaves(parse(text) or {}))
            if target is not None:
                goal, rescued, why = loads(target), {}, []
                for path, v in record.items():
                    kinds = goal.get(path)
                    if not path:
                        continue
                    if kinds is None:
                        rescued[path] = v
                        why.append((path, "added"))
                    elif v is not None and kinds and json_type(v) not in kinds:
                        rescued[path] = v
                        why.append((path, "type_changed"))
                if rescued or matched:
                    out.append((cache, store, file_no, 1, key, raw_id, dumps(rescued) if rescued else None, why))
            if ending is not None:
                out.append((cache, store, after, 0, key, raw_id, dumps({p: record[p] for p in ending if record.get(p) is not None}), []))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)


def enforce(raw: DataFrame, layout: DataFrame) -> DataFrame:
    """Ingestion of each file under the schema of the store's earlier file.

    cache_id, store, step (the later file), side, rec_key, raw_id, _rescued, why. Side 1: records of the later file that
    have rescued values, with the reason by path (``added``: unknown to the target; ``type_changed``: not of its types).
    Side 0: records of the earlier file with their values of the fields that end there. Where a step ends fields and has
    new ones, all its records are given on both sides, as such fields may be the same under another name.
    """
    swapped = (F.size(_less("own", "following")) > 0) & (F.size(_less("following", "own")) > 0)
    plan = layout.select(
        *FILE,
        F.when(F.size("target") >= 0, F.to_json("target")).alias("target"),
        F.when(F.col("following").isNotNull() & swapped, F.col("after")).alias("after"),
        F.when(F.col("following").isNotNull() & swapped, _less("own", "following")).alias("ending"),
        F.coalesce((F.size(_less("target", "own")) > 0) & (F.size(_less("own", "target")) > 0), F.lit(False)).alias("matched"),
    ).filter("target is not null or ending is not null")
    rows = raw.select("cache_id", "store", "file_no", "rec_key", "raw_id", "payload").join(plan, FILE)
    rows = rows.select("cache_id", "store", "file_no", "rec_key", "raw_id", "payload", "target", "after", "ending", "matched")
    return rows.mapInArrow(_enforced_batches, f"cache_id long, store string, step int, side int, rec_key string, raw_id long, {RESCUED} string, why map<string,string>")


def changes(raw: DataFrame) -> DataFrame:
    """cache_id, file_no, store, change_type, field_name, new_name: each file's fields against those of the store's latest earlier file.

    Every file is ingested under the earlier file's schema (``enforce``). Unknown fields in the rescue column are added,
    values there that the target's types can't hold make a type change (so does a type of the target that no value has
    any more), fields of the target that no record has are removed. Of a step that removes and adds fields the rescued
    values are replayed record by record into the removed fields: fields that hold the same are renamed.

    A field without a typed value on one side has no type change. Where several removed and added fields hold the same
    values, they are paired in alphabetical order, each once.
    """
    layout = cut(layouts(raw))  # a row per file and store, read below for targets and for what is absent
    records = cut(enforce(raw, layout))  # only what drifted
    key = ["cache_id", "store", "file_no"]
    rescued = records.filter("side = 1").select("cache_id", "store", F.col("step").alias("file_no"), F.explode("why").alias("field_name", "change_type")).distinct()
    gone = layout.filter("target is not null").select(*key, F.explode(_less("target", "own")).alias("field_name"), F.lit("removed").alias("change_type"))
    kept = layout.filter("target is not null").select(*key, "own", F.explode("target").alias("field_name", "old"))
    now = F.try_element_at("own", "field_name")
    narrowed = kept.filter((F.size("old") > 0) & (F.size(now) > 0) & (F.size(F.array_except(now, "old")) == 0) & (F.size(F.array_except("old", now)) > 0)).select(*key, "field_name", F.lit("type_changed").alias("change_type"))
    plain = rescued.unionByName(gone).unionByName(narrowed)
    renames = cut(_renames(records))

    was = renames.select(*key, "field_name", F.lit("removed").alias("change_type"))
    became = renames.select(*key, F.col("new_name").alias("field_name"), F.lit("added").alias("change_type"))
    rest = plain.join(was.unionByName(became), [*key, "field_name", "change_type"], "left_anti")
    columns = ["cache_id", "file_no", "store", "change_type", "field_name", "new_name"]
    return rest.withColumn("new_name", F.lit("")).select(*columns).unionByName(renames.withColumn("change_type", F.lit("renamed")).select(*columns))


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of record and value for each value of either side."""
    dumps = json.JSONEncoder(sort_keys=True, ensure_ascii=False).encode
    for batch in batches:
        at, sides, fields, first, second = [], [], [], [], []
        for i, (key, old, new, added) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("rec_key", "old", "new", "added")], strict=True)):
            for side, text in ((0, old), (1, new)):
                for path, v in json.loads(text).items() if text else ():
                    if v is not None and (not side or path in added):
                        bare = f"{key}\x00{dumps(v)}".encode("utf-8", "surrogatepass")
                        at.append(i), sides.append(side), fields.append(path)
                        first.append(xxhash.xxh64_intdigest(bare) - 2**63), second.append(xxhash.xxh64_intdigest(bare, 1) - 2**63)
        rows = batch.select(["cache_id", "store", "step"]).take(pa.array(at, pa.int64()))
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(v, k) for v, k in zip((sides, fields, first, second), kinds, strict=True)]], names=[*rows.schema.names, "side", "field", "h1", "h2"])


def _renames(records: DataFrame) -> DataFrame:
    """cache_id, store, file_no, field_name, new_name of the fields that went on under another name.

    The values that a field has in the records of both files are summed to a print of 128 bits; a removed and an added
    field of a step match where prints and counts are equal. Equal prints make a class, paired by rank, so that neither
    records nor fields are multiplied.
    """
    step = ["cache_id", "store", "step"]
    # One row per record that both files have (of copies the highest raw_id counts); of the rescued values only those of unknown fields.
    some = records.filter("rec_key is not null")
    order = {side: F.when(F.col("side") == side, F.col("raw_id")) for side in (0, 1)}
    held = some.groupBy(*step, "rec_key").agg(
        F.max_by(F.struct(RESCUED), order[0]).alias("old"),
        F.max_by(F.struct(RESCUED, F.map_keys(F.map_filter("why", lambda _, v: v == "added")).alias("added")), order[1]).alias("new"),
    )
    both = held.filter("old is not null and new is not null").select(*step, "rec_key", F.col(f"old.{RESCUED}").alias("old"), F.col(f"new.{RESCUED}").alias("new"), F.col("new.added").alias("added"))
    prints = both.mapInArrow(_print_batches, "cache_id long, store string, step int, side int, field string, h1 long, h2 long")
    sums = prints.groupBy(*step, "side", "field").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    known = ["h1", "h2", "n"]
    ranked = sums.withColumn("r", F.row_number().over(W.partitionBy(*step, "side", *known).orderBy("field")))
    old, new = (ranked.filter(F.col("side") == side).select(*step, *known, "r", F.col("field").alias(name)) for side, name in ((0, "field_name"), (1, "new_name")))
    return old.join(new, [*step, *known, "r"]).select("cache_id", "store", F.col("step").alias("file_no"), "field_name", "new_name")


# Rescue-column tables


def _ingest(target: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, rescued = [], []
        for text in batch.column("payload").to_pylist():
            record = parse(text)
            typed, rest = {}, {}
            for path, v in leaves(record) if record is not None else [("", text)] if text is not None else []:
                kind = target.get(path)
                cast = to_type(v, kind) if kind else None
                if kind and (cast is not None or v is None):
                    typed[path] = cast
                else:
                    rest[path] = v
            rows.append(typed)
            rescued.append(json.dumps(rest, ensure_ascii=False, sort_keys=True) if rest else None)
        keys = [c for c in batch.schema.names if c != "payload"]
        arrays = [*batch.select(keys).columns, *[pa.array([r.get(p) for r in rows], ARROW[k]) for p, k in target.items()], pa.array(rescued, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *target, RESCUED])


ARROW = {"string": pa.string(), "number": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "array": pa.string()}
SQL_TYPES = {"string": "string", "number": "double", "long": "bigint", "boolean": "boolean", "array": "string"}


def to_type(v: object, kind: str) -> object:
    """The value as ``kind``, or None where that would change it. Arrays are kept as JSON text."""
    if v is None:
        return None
    if kind == "string":
        return v if isinstance(v, str) else None
    if kind == "boolean":
        return v if isinstance(v, bool) else {"true": True, "false": False}.get(v) if isinstance(v, str) else None
    if kind == "array":
        return json.dumps(v, ensure_ascii=False) if isinstance(v, list) else None
    if isinstance(v, bool) or not isinstance(v, (int, float, str)):
        return None
    try:
        if kind == "long":
            n = int(v) if not isinstance(v, float) else int(v) if v == int(v) else None
            return n if n is not None and -(2**63) <= n < 2**63 else None
        n = float(v)
        return n if isinstance(v, float) or n == int(v if not isinstance(v, str) else n) or isinstance(v, str) else None
    except (ValueError, OverflowError):
        return None


def ingest(raw: DataFrame, target: Mapping[str, str], keys: tuple[str, ...] = ("raw_id", "cache_id", "file_no", "store", "rec_key")) -> DataFrame:
    """The records as one table: ``keys``, a column per field of ``target`` (path to type), and the rescue column.

    A field named like one of ``keys``, or like an earlier field but for case, gets no column and stays rescued.
    """
    goal: dict[str, str] = {}
    taken = {c.lower() for c in (*keys, RESCUED)}
    for path, kind in target.items():
        if path.lower() not in taken:
            goal[path] = kind
            taken.add(path.lower())
    rows = raw.select(*keys, "payload")
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"`{p}` {SQL_TYPES[k]}" for p, k in goal.items()), f"`{RESCUED}` string"])
    return rows.mapInArrow(lambda b: _ingest(goal, b), schema)


def promote(table: DataFrame, approved: Mapping[str, str]) -> DataFrame:
    """Give approved fields typed columns and replay their rescued values into them; what can't be cast stays rescued."""
    goal, names = dict(approved), [c for c in table.columns if c != RESCUED]
    new = {p: k for p, k in goal.items() if p.lower() not in {n.lower() for n in names}}
    types = dict(table.dtypes)
    at = {c: f"c{i}" for i, c in enumerate(table.columns)}  # names with dots don't reach Python as columns

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {p: [] for p in new}
            left = []
            for text in batch.column(at[RESCUED]).to_pylist():
                rest = json.loads(text) if text else {}
                for p, k in new.items():
                    cast = to_type(rest.get(p), k)
                    columns[p].append(cast)
                    if cast is not None or rest.get(p, 0) is None:
                        rest.pop(p, None)
                left.append(json.dumps(rest, ensure_ascii=False, sort_keys=True) if rest else None)
            arrays = [*batch.select([at[c] for c in names]).columns, *[pa.array(columns[p], ARROW[k]) for p, k in new.items()], pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *new, RESCUED])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), *(f"`{p}` {SQL_TYPES[k]}" for p, k in new.items()), f"`{RESCUED}` string"])
    return table.toDF(*at.values()).mapInArrow(replay, schema)


def held_fields(raw: DataFrame) -> dict[str, list[tuple[str, str, float]]]:
    """By store: each field with the type that most files give it and the share of the store's files that hold it.

    A row per store and field comes to the driver: as many as the layouts of the stores have.
    """
    seen = schemas(raw)
    counted = seen.select("store", "path", F.explode_outer("types").alias("type")).groupBy("store", "path", "type").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("store", "path").agg(F.max(F.struct(F.when(F.col("type").isNotNull(), F.col("n")).alias("n"), "type")).alias("b"), F.sum("n").alias("all"))
    found: dict[str, list[tuple[str, str, float]]] = {}
    rows = best.orderBy("store", "path").collect()
    files = {r.store: r["all"] for r in rows if r.path == ""}
    for r in rows:
        if r.path and r.b.type is not None:
            found.setdefault(r.store, []).append((r.path, r.b.type, r["all"] / files[r.store]))
    return found


def majority_schema(raw: DataFrame, store: str, share: float = 0.5) -> dict[str, str]:
    """Fields of a store that at least ``share`` of its files hold, each with the type most files give it."""
    return {p: k for p, k, held in held_fields(raw.filter(F.col("store") == store)).get(store, []) if held >= share}


def one_each(raw: DataFrame) -> DataFrame:
    """Repeated rows of a record in a file once (the highest raw_id)."""
    w = W.partitionBy("cache_id", "file_no", "store", "rec_key").orderBy(F.desc("raw_id"))
    return raw.select("raw_id", "cache_id", "file_no", "store", "rec_key", "payload").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def store_table(raw: DataFrame, store: str, target: Mapping[str, str] | None = None) -> DataFrame:
    """One table of a store over all its files: repeated rows once, typed fields, the rest rescued."""
    once = one_each(raw.filter(F.col("store") == store))
    return ingest(once, majority_schema(raw, store) if target is None else target)


def promoted_counts(raw: DataFrame, first: float = 0.9, approved: float = 0.5) -> DataFrame:
    """Ingest, then promote: store, cache_id, file_no, records, replayed, rescued.

    Each store is ingested under the fields that ``first`` of its files hold; those that ``approved`` of them hold are
    promoted then, and their rescued values replayed. ``replayed`` counts the values that went from the rescue column
    into typed columns, ``rescued`` the records that still have some left.
    """
    parts = []
    for store, fields in sorted(held_fields(raw).items()):
        base = {p: k for p, k, held in fields if held >= first}
        new = {p: k for p, k, held in fields if approved <= held < first}
        table = promote(store_table(raw, store, base), new)
        names = [c for c in table.columns if c in new]
        filled = sum((F.col(f"`{c}`").isNotNull().cast("long") for c in names), F.lit(0).cast("long"))
        parts.append(table.groupBy("store", "cache_id", "file_no").agg(F.count(F.lit(1)).alias("records"), F.sum(filled).alias("replayed"), F.count(RESCUED).alias("rescued")))
    if not parts:
        return raw.sparkSession.createDataFrame([], "store string, cache_id long, file_no int, records long, replayed long, rescued long")
    return reduce(DataFrame.unionByName, parts)
