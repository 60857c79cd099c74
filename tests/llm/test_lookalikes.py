import random

import pytest
from pyspark.sql import functions as F

from kassaflow.llm import lookalikes as L
from kassaflow.llm.looks import skeleton

SAME = [
    ("Full width 12", "Ｆull ｗidth １２"),
    ("café", "café"),
    ("zero width", "ze​ro wid­th﻿"),
    ("statement", "ѕtаtеmеnt"),
    ("MOTION", "ΜΟΤΙΟΝ"),
    ("final fluff", "ﬁnal ﬂuff"),
    ("Bold", "𝖡𝗈𝗅𝖽"),
    ("предаване на нощта", "предaвaне нa нощтa"),
    ("a b", "a b"),
]
DIFFERENT = [("m2", "m²"), ("word", "Word"), ("cafe", "café"), ("a\nb", "a b"), ("a  b", "a b"), ("1", "l"), ("a *", "a"), ("Oslo", "0slo"), ("it's", "it’s"), ("a\tb", "a b")]


def pairs(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, token string")
    return [tuple(r) for r in L.same_looks(df).collect()]


def brute(texts):
    return sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and a != b and skeleton(a) == skeleton(b))


def test_pairs(spark):
    texts = [x for p in SAME for x in p] + [x for p in DIFFERENT for x in p] + [None, "", "", "statement", "statement"]
    got = pairs(spark, texts)
    assert len(got) == len(set(got)) and sorted(got) == brute(texts)
    want = {(2 * i, 2 * i + 1) for i in range(len(SAME))}
    assert want <= set(got)
    assert not any(i >= 2 * len(SAME) and (i, i + 1) in got for i in range(0, 2 * (len(SAME) + len(DIFFERENT)), 2))


def test_random_disguises_and_hot_texts(spark):
    r = random.Random(4)
    swap = {"a": "а", "e": "е", "o": "ο", "s": "ѕ", " ": " ", "d": "ԁ"}
    base = ["the sitting was suspended and resumed", "la séance est levée", "се обажда на Oslo", "а се", "ce"]
    texts = []
    for _ in range(150):
        t = r.choice(base)
        texts.append("".join(swap.get(c, c) if r.random() < 0.2 else c + "‌" * (r.random() < 0.1) for c in t))
    texts += ["the same text"] * 60 + ["the ѕame text"] * 2
    assert sorted(pairs(spark, texts)) == brute(texts)


def test_classes_and_empty_table(spark):
    df = spark.createDataFrame([(5, "abc"), (3, "аbc"), (1, "abd"), (9, None), (8, "abc")], "doc_id long, text string")
    want = [(1, 1, 1, 1, 0), (3, 3, 3, 1, 2), (5, 3, 5, 2, 1), (8, 3, 5, 2, 1)]
    assert sorted((r.doc_id, r.class_id, r.exact_id, r.copies, r.links) for r in L.class_members(df).collect()) == want
    assert [(r.doc_id_a, r.doc_id_b) for r in L.class_links(df).collect()] == [(3, 5)]
    assert L.same_looks(df.limit(0)).count() == 0 and L.class_members(df.limit(0)).count() == 0 and L.class_links(df.limit(0)).count() == 0


def test_a_third_of_the_documents_in_one_class(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_SHARE", 20)
    texts = ["the same text"] * 150 + ["the ѕame text"] * 40 + ["the same tex\u200bt", "other", "οther"] + [f"text {i}" for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pairs_ = sorted(map(tuple, L.same_looks(df).collect()))
    assert pairs_ == brute(texts) and len(pairs_) == 150 * 40 + 150 + 40 + 1
    rows = {r.doc_id: r for r in L.class_members(df).collect()}
    assert len(rows) == len(texts) and sum(r.links for r in rows.values()) == 2 * len(pairs_)
    assert sorted((a, b) for a in rows for b in rows if a < b and rows[a].class_id == rows[b].class_id and rows[a].exact_id != rows[b].exact_id) == pairs_
    assert sorted(map(tuple, L.class_links(df).collect())) == [(0, 150), (0, 190), (191, 192)]


def test_canonical_texts_keep_the_script(spark):
    df = spark.createDataFrame([(1, "предаване"), (2, "предaване x"), (3, "statement"), (4, "ѕtatement")], "doc_id long, text string").withColumn("n", F.lit(1))
    changed, table = L.canonical_texts(df)
    assert {r.doc_id: r.text for r in changed.collect()} == {2: "предаване x", 4: "statement"}
    assert {r.token: r.canonical for r in table.collect()} == {"предaване": "предаване", "ѕtatement": "statement"}


def test_trie_costs():
    t = L.Trie()
    for w, n in (("statement", 5), ("état", 3), ("fluff", 1)):
        t.add(w, n)
    assert t.search("ѕtа​tеment") == [(0.0, "statement", 5)]
    assert t.search("état") == [(0.0, "état", 3)] and t.search("etat") == [] and t.search("ﬂuﬀ") == [(0.0, "fluff", 1)]
    assert t.search("statemnt", 1.0) == [(1.0, "statement", 5)] and t.search("statemennt", 1.0)[0][0] == 1.0 and t.search("stetement", 1.0)[0][0] == 1.0
    assert L.choose([], "аbc") == "abc"


@pytest.mark.parametrize("a, b", SAME)
def test_table_form_depends_on_looks_only(a, b):
    assert [L.table_form(x) for x in L.split_tokens(a)] == [L.table_form(x) for x in L.split_tokens(b.replace(" ", " ").replace(" ", " "))]


def test_many_small_tries_give_the_same(spark, monkeypatch):
    texts = [x for p in SAME for x in p] * 2 + [f"wоrd{i} word{i}" for i in range(200)] + [f"word{i} word{i}" for i in range(200)]
    monkeypatch.setattr(L, "TRIE_TOKENS", 20)
    assert sorted(pairs(spark, texts)) == brute(texts)
