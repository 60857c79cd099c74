import os

import pytest
from pyspark.sql import functions as F

from kassaflow.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.BYTE_BPE), reason="no tokenizer file")
TEXTS = ["Hello, world", "", None, "Шоу 👍🏽 日本", "a" * 60_000, " \n\t ", "<|endoftext|>", "é́", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, [9]) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")


def test_ids_are_the_library_s_and_nulls_are_empty(docs):
    t = encode.load(encode.BYTE_BPE)
    got = {r.doc_id: list(r.ids) for r in encode.encode(docs).collect()}
    assert len(got) == len(TEXTS) and got[1] == got[2] == []
    assert all(got[i] == t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS))
    assert 50256 not in got[6] and got[8] == got[9]


def test_round_trip(docs):
    back = {r.doc_id: (r.text, r.broken) for r in encode.decode(encode.encode(docs)).collect()}
    assert back == {i: (x or "", 0) for i, x in enumerate(TEXTS)}


def test_round_trip_in_one_pass(docs):
    t = encode.load(encode.BYTE_BPE)
    got = {r.doc_id: (r.n_tokens, r.broken, r.same) for r in encode.round_trip(docs).collect()}
    assert got == {i: (len(t.encode(x or "", add_special_tokens=False).ids), 0, True) for i, x in enumerate(TEXTS)}
    assert encode.round_trip(docs.limit(0)).count() == 0


def test_offsets_cover_the_text_and_split_characters(docs):
    for r in encode.encode_with_offsets(docs).collect():
        text = TEXTS[r.doc_id] or ""
        data = text.encode()
        assert len(r.ids) == len(r.char_start) == len(r.char_end) == len(r.byte_start)
        for b, s, e in zip(r.byte_start, r.char_start, r.char_end):
            assert len(text[:s].encode()) <= b < len(text[:e].encode()) <= len(data)
    thumb = encode.encode_with_offsets(docs.where("doc_id = 3")).first()
    assert any(a == b for a, b in zip(thumb.char_start, thumb.char_start[1:]))


def test_cut_inside_a_character(docs):
    ids = encode.encode(docs.where("doc_id = 3")).select("doc_id", F.expr("slice(ids, 1, size(ids) - 1)").alias("ids"))
    got = encode.decode(ids).first()
    assert got.broken > 0 and got.text.endswith("�") and TEXTS[3].startswith(got.text.rstrip("�"))


def test_empty_table_and_byte_table(docs):
    assert encode.encode(docs.limit(0)).count() == 0 and encode.decode(encode.encode(docs.limit(0))).count() == 0
    assert sorted(encode.byte_table().values()) == list(range(256))
