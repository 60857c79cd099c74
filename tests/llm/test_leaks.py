import random

import numpy as np
import pytest

from kassaflow.llm import leaks

R = random.Random(11)
COMMON = [f"common{i}" for i in range(60)]


def noise(n):
    return [R.choice(COMMON) for _ in range(n)]


PASSAGES = [(i, " ".join(w for j in range(14) for w in (R.choice(COMMON[:20]), f"Rare{i}x{j}"))) for i in range(20)]


def stretch(i, a, b):
    return PASSAGES[i][1].split()[a:b]


def touched(i):
    w = stretch(i, 0, 24)
    w[7] = "other"
    return [*w[:12], "(interruption:", "shame!)", *[x.upper() for x in w[12:]]]


CASES = {
    1: (stretch(0, 0, 28), 0),  # whole
    2: (stretch(1, 5, 19), 1),  # a part
    3: (touched(2), 2),
    4: ([w.replace("a", "а").replace("e", "é") for w in stretch(3, 2, 22)], 3),  # Cyrillic а
    5: (stretch(4, 0, 6), None),  # a few words
    6: (noise(0), None),
    7: (stretch(5, 0, 12), 5),
}


@pytest.fixture(scope="module")
def frames(spark):
    docs = [(i, " ".join(noise(40) + w + noise(30))) for i, (w, _) in CASES.items()]
    docs += [(100 + i, " ".join(noise(R.randrange(3, 200)))) for i in range(400)] + [(900, None), (901, ""), (902, "x")]
    docs += [(950, docs[0][1])]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, eval_id int")
    e = spark.createDataFrame([(i, p, 0) for i, p in PASSAGES] + [(90, None, 0), (91, "", 0), (92, "two words", 0)], "eval_id long, passage string, doc_id int")
    return d, e


WANT = {(i, e) for i, (_, e) in CASES.items() if e is not None} | {(950, 0)}


@pytest.mark.parametrize("shard_words", [200, 1_000_000])
def test_leaks_are_found_whatever_the_shards(frames, shard_words):
    d, e = frames
    assert {(r.doc_id, r.eval_id) for r in leaks.leaked(d, e, shard_words=shard_words).collect()} == WANT


def test_blocks_of_passages(frames, monkeypatch):
    d, e = frames
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 150)
    assert len(list(leaks.passage_blocks(PASSAGES))) > 3
    assert {(r.doc_id, r.eval_id) for r in leaks.leaked(d, e).collect()} == WANT


def test_removal_and_empty_tables(frames):
    d, e = frames
    found = leaks.leaked(d, e)
    kept = {r.doc_id for r in leaks.without_leaks(d, found).collect()}
    assert kept == {r.doc_id for r in d.collect()} - {i for i, _ in WANT}
    assert leaks.leaked(d.limit(0), e).count() == 0 and leaks.leaked(d, e.limit(0)).count() == 0


@pytest.mark.parametrize("vocabulary, seed", [(6, 3), (2, 3), (1, 1), (6, 2), (3000, 3)])
def test_suffix_array_finds_all_maximal_matches(vocabulary, seed):
    r = random.Random(2)
    some = [f"w{i}" for i in range(vocabulary)]
    tests = [(i, " ".join(r.choice(some[:6]) for _ in range(15))) for i in range(6)] + [(9, " ".join(some))]
    t = leaks._block([(i, p.split()) for i, p in tests], seed)
    copies = [t.vocabulary.get(r.choice([*some[:6], "none"]), 0) for _ in range(60)]
    flat = np.array([0] + [t.vocabulary.get(r.choice([*some[:6], "none"]), 0) for _ in range(200)] + [0] + (copies + [0]) * 3, np.int32)
    starts = np.array([1, 120, 202, 263, 324])
    got, runs = set(), []
    for i, j, m in leaks.SuffixArray(flat, len(t.vocabulary) + 1, seed, int(t.sizes.max())).matches(t, starts, chunk=50):
        got |= {(p, q, n) for _, _, p, q, n in m.T.tolist()}
        assert all(starts[d] <= p and i <= d < j for d, _, p, _, _ in m.T.tolist())
        runs.append((i, j))
    assert [i for i, _ in runs] == [0, *(j for _, j in runs[:-1])] and runs[-1][1] == 5 and len(runs) > 1
    want = set()
    for p in range(len(flat)):
        for q in range(len(t.flat)):
            if p and q and flat[p - 1] and flat[p - 1] == t.flat[q - 1]:
                continue
            n = 0
            while p + n < len(flat) and q + n < len(t.flat) and flat[p + n] and flat[p + n] == t.flat[q + n]:
                n += 1
            if n >= seed:
                want.add((p, q, n))
    assert got == want and want


def test_suffixes_stand_in_full_order_and_longest_matches_are_those_of_the_neighbours():
    r = random.Random(5)
    run = [r.randrange(1, 9) for _ in range(70)]
    flat = np.array([0, *run, 0, *run, 0, *[r.randrange(0, 9) for _ in range(300)], 0], np.int32)
    s = leaks.SuffixArray(flat, 9, 3)

    def suffix(a, at):
        out = []
        while at < len(a) and a[at]:
            out.append(int(a[at]))
            at += 1
        return out

    order = [suffix(flat, p) for p in s.places]
    assert order == sorted(order)
    t = leaks.Tests([0], {}, np.array([*run[10:60], 3, 3, 3, 0], np.int32), np.array([0]), 3)
    q = leaks._begins(t.flat, 3)
    point, before, behind = s.insertion(t, q)
    for i, k, a, b in zip(q, point, before, behind):
        mine = suffix(t.flat, i)
        assert k == sum(o < mine for o in order)
        shares = [next((n for n, (x, y) in enumerate(zip(o, mine)) if x != y), min(len(o), len(mine))) for o in order]
        assert max(a, b) == max(shares) and (k == 0 or a == shares[k - 1]) and (k == len(order) or b == shares[k])


def test_long_texts(spark):
    d = spark.createDataFrame([(1, " ".join(noise(30_000) + stretch(6, 0, 28) + noise(30_000)))], "doc_id long, text string")
    e = spark.createDataFrame(PASSAGES, "eval_id long, passage string")
    assert [(r.doc_id, r.eval_id) for r in leaks.leaked(d, e).collect()] == [(1, 6)]


def test_copies_that_are_a_third_of_the_corpus_leak_too(spark):
    text = " ".join(noise(10) + stretch(8, 3, 23) + noise(10))
    docs = [(i, text) for i in range(300)] + [(1000 + i, " ".join(noise(30))) for i in range(600)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(PASSAGES, "eval_id long, passage string")
    assert {(r.doc_id, r.eval_id) for r in leaks.leaked(d, e).collect()} == {(i, 8) for i in range(300)}


def test_near_copies_in_differing_texts_that_are_a_third_of_the_corpus_leak_too(spark):
    def copy(i):
        w = stretch(9, i % 5, 28 - i % 3)
        w[4 + R.randrange(6)] = w[14 + R.randrange(6)] = f"touched{i}"
        return noise(10 + R.randrange(20)) + w + noise(10 + R.randrange(20))

    docs = [(i, " ".join(copy(i))) for i in range(300)] + [(1000 + i, " ".join(noise(30))) for i in range(600)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(PASSAGES, "eval_id long, passage string")
    assert {(r.doc_id, r.eval_id) for r in leaks.leaked(d, e).collect()} == {(i, 9) for i in range(300)}


def test_a_verbatim_passage_of_common_words_leaks_and_a_formula_of_many_passages_does_not(spark):
    r = random.Random(4)
    plain = r.sample(COMMON, 20)
    formula = r.sample(COMMON, 14)
    passages = [(0, " ".join(plain)), (1, " ".join(plain))] + [(10 + i, " ".join([*formula, *(f"Own{i}x{j}" for j in range(14))])) for i in range(6)]
    docs = [(1, " ".join(noise(20) + plain + noise(20))), (2, " ".join(noise(20) + formula + noise(20)))] + [(100 + i, " ".join(noise(60))) for i in range(400)]
    docs += [(2000 + i, " ".join([*formula, f"other{i}"])) for i in range(30)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "eval_id long, passage string")
    assert {(x.doc_id, x.eval_id) for x in leaks.leaked(d, e).collect()} == {(1, 0), (1, 1)}


@pytest.mark.parametrize("n", range(1, 12))
def test_short_passages_leak_as_a_whole_only(spark, n):
    passage = [f"short{n}x{j}" for j in range(n - 1)] + [COMMON[n]]
    gap = passage[:3] + ["between"] * (n > 3) + passage[3:]
    docs = [(1, noise(9) + passage + noise(9)), (2, noise(9) + passage[:-1] + ["other"]), (3, noise(9)), (4, ["first", *gap, "last"])]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [(50 + i, " ".join(COMMON[20:40])) for i in range(40)], "doc_id long, text string")
    e = spark.createDataFrame([(7, " ".join(passage)), *PASSAGES[1:4]], "eval_id long, passage string")
    want = {i for i, w in docs if i in (1, 4) or n == 1 and COMMON[1] in w}
    assert {(x.doc_id, x.eval_id) for x in leaks.leaked(d, e).collect()} == {(i, 7) for i in want}


@pytest.mark.parametrize("n, leaks_", [(10, True), (30, True), (60, True), (400, False)])
def test_a_stretch_goes_on_behind_an_interruption(spark, n, leaks_):
    # neither part is a stretch of its own
    text = noise(20) + stretch(10, 2, 12) + noise(n) + stretch(10, 12, 22) + noise(20)
    d = spark.createDataFrame([(1, " ".join(text))] + [(100 + i, " ".join(noise(30))) for i in range(50)], "doc_id long, text string")
    e = spark.createDataFrame(PASSAGES, "eval_id long, passage string")
    assert [(x.doc_id, x.eval_id) for x in leaks.leaked(d, e).collect()] == [(1, 10)] * leaks_


def test_verbatim_copies_of_common_words_leak_whatever_share_of_the_corpus_holds_them(spark):
    # 14 words that stand everywhere, in an order of their own, whole or from the third on
    plain = random.Random(8).sample(COMMON, 14)
    for share in (1, 30, 300):
        docs = [(i, " ".join([*noise(R.randrange(1, 9)), *plain[(i % 2) * 2 :], *noise(R.randrange(1, 9))])) for i in range(share)]
        docs += [(1000 + i, " ".join(noise(30))) for i in range(600)]
        d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(3, " ".join(plain)), *PASSAGES], "eval_id long, passage string")
        assert {(x.doc_id, x.eval_id) for x in leaks.leaked(d, e).collect()} == {(i, 3) for i in range(share)}, share


def test_a_passage_left_out_in_the_middle_leaks_by_its_parts(spark):
    text = noise(9) + stretch(11, 0, 13) + stretch(11, 22, 28) + noise(9)
    d = spark.createDataFrame([(1, " ".join(text)), (2, "x")], "doc_id long, text string")
    e = spark.createDataFrame(PASSAGES, "eval_id long, passage string")
    assert [(x.doc_id, x.eval_id) for x in leaks.leaked(d, e).collect()] == [(1, 11)]
