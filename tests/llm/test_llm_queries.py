import os

import pytest
from oracle import SMALL, connection, same

from threadlake.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, connection(), QUERIES[name], SQL[name])


def read(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


def run(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, SMALL).collect()]


def test_redacted_texts_hold_nothing(spark):
    assert run(spark, "p1_left") == []


def test_redaction_changes_what_is_found_only(spark):
    before = {r["row_no"]: (r["content"], r["sender_name"]) for r in read("messages")}
    after = {r.row_no: (r.content, r.sender_name) for r in QUERIES["p1_redacted"](spark, SMALL).collect()}
    found = {(f, n) for f, n, _ in run(spark, "p1_found") if f != "attendees"}
    assert before.keys() == after.keys()
    assert {(f, n) for n in before for k, f in enumerate(("content", "sender_name")) if before[n][k] != after[n][k]} == found


def test_every_document_is_encoded(spark):
    from tokenizers import Tokenizer

    from threadlake.llm import tokens

    plain = Tokenizer.from_file(tokens.vocabulary())
    plain.encode_special_tokens = True
    docs = {r["doc_id"]: r["text"] for r in read("documents")}
    assert dict(run(spark, "p8_ids")) == {k: plain.encode(t, add_special_tokens=False).ids if t else [] for k, t in docs.items()}


def test_leaks_of_all_documents(spark):
    from threadlake.llm import leaks

    def windows(text):
        w = leaks.words(text or "")
        return {tuple(w[k : k + 12]) for k in range(len(w) - 11)}

    items = {r["item_id"]: windows(r["passage"]) for r in read("eval_items")}
    own = {r["doc_id"]: windows(r["text"]) for r in read("documents")}
    found = run(spark, "p9_found")
    assert set(found) == {(d, i) for d, w in own.items() for i, p in items.items() if w & p} and found
    # A copy with other values is no leak of its class.
    assert not {(d, i) for d, i, *_ in run(spark, "p9_reparameterised")} & set(found)


def test_evidence_names_the_excluded(spark):
    from threadlake.llm import residue

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {d for (d,) in run(spark, "p10_found")}
    assert {d for d, _ in run(spark, "p10_evidence")} == out and {r.doc_id for r in residue.clean(docs).collect()} == {r["doc_id"] for r in read("documents")} - out


def test_round_trip_is_empty(spark):
    assert QUERIES["p8_round_trip"](spark, SMALL).count() == 0


def test_attendees_are_redacted_where_found(spark):
    before = {r.row_no: r.attendees for r in spark.read.parquet(f"{SMALL}/calendar_events.parquet").select("row_no", "attendees").collect()}
    after = {r.row_no: r.attendees for r in QUERIES["p1_attendees_redacted"](spark, SMALL).collect()}
    found = {r.row_no for r in QUERIES["p1_found"](spark, SMALL).filter("field_name = 'attendees'").collect()}
    assert found and before.keys() == after.keys() and {k for k in before if before[k] != after[k]} == found
    assert all([a and a.e for a in before[k] or []] == [a and a.e for a in after[k] or []] for k in before)
