"""Test passages leaking into training text, by suffix arrays of the training text.

The corpus is read once, in shards (as many documents of a task as fit a bound
of words). Of each shard a suffix array is built: the places where words of the
tests' vocabulary follow each other, in the full order of the words that begin
there. Every suffix of every test passage is binary-searched in it. Its longest
match is that with a neighbour of its insertion point; the length of its match
at any other place is the least common prefix between there and that point.
Matches go on document by document, never as the product of a whole shard.

Documents with matches are written as word numbers with their matches, beside
the counts of words. In the second step, over those only, the words around the
matches of a document and a passage are aligned, so that a copy that was
touched up in single words or interrupted is one stretch.

The passages are the query set. They are read one partition at a time and held
by every task in blocks of at most ``BLOCK_WORDS`` words; each block is
searched in all documents.

Leaks must not make their own words common: an occurrence of a word inside a
quotation of a passage isn't counted when rare words are chosen, and a
quotation of enough words needs no rare word. What more than ``Rule.shared``
different passages of a block have is a common formula, not a quotation.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .looks import loose

WORD = re.compile(r"[^\W_]+")
#: Words of a verbatim match that is looked at; of a shorter passage, all its words.
SEED = 3
#: A shard is closed at this many words.
SHARD_WORDS = 2_000_000
#: Words of one block of passages, with repeats: what a task holds of the query set (about 16 bytes a word).
BLOCK_WORDS = 1 << 20
#: Matches that are held at once, or those of one document.
CHUNK_MATCHES = 2_000_000


@dataclass(frozen=True)
class Rule:
    """When a stretch counts as leaked.

    least: words of the stretch in the passage. share: of these, found in order.
    score: matched words less penalties (``skip`` for a passage word left out,
    ``insert`` for a document word put in); an interruption may be as long as
    the words on both sides of it outweigh. rare: matched words that few
    documents have; from a score of ``sure`` on one of them is enough.
    rare_share: of the stretch's rare words, those matched; a text made by the
    same pattern shares the common words only. A word is rare up to
    ``rare_part`` of all documents, or ``rare_least`` documents. near: words
    that may part the matches of one quotation. beside: words that are aligned
    before and behind a match. shared: different passages that may have a
    quotation, or a quoted word (of that, a part of ``shared_part`` at least);
    what more have is a common formula. dense: words of a quotation in
    verbatim matches of ``SEED`` words and more.
    """

    least: int = 12
    share: float = 0.8
    score: float = 8.0
    sure: float = 14.0
    rare: int = 2
    rare_share: float = 0.65
    rare_part: float = 0.002
    rare_least: int = 10
    skip: float = 1.2
    insert: float = 0.1
    near: int = 6
    beside: int = 48
    shared: int = 3
    shared_part: float = 0.01
    dense: float = 0.6


def words(text: str | None) -> list[str]:
    """The words of a text without case, accents, look-alikes and unseen characters."""
    return WORD.findall(loose(text)) if text else []


@dataclass
class Tests:
    """A block of passages as word numbers; 0 is any word that no passage has, and stands behind each passage."""

    ids: list[int]
    vocabulary: dict[str, int]
    flat: np.ndarray
    starts: np.ndarray
    seed: int

    @property
    def sizes(self) -> np.ndarray:
        """Words of each passage."""
        return np.diff(np.append(self.starts, len(self.flat))) - 1


def _pack(flat: np.ndarray, at: np.ndarray, depth: int, base: int) -> np.ndarray:
    """The words at..at+depth of each place as one number; words behind an unknown one count as unknown."""
    key = np.zeros(len(at), np.int64)
    known = np.ones(len(at), bool)
    for j in range(depth):
        w = flat[np.minimum(at + j, len(flat) - 1)].astype(np.int64)
        known &= (w > 0) & (at + j < len(flat))
        key = key * base + np.where(known, w, 0)
    return key


def _begins(flat: np.ndarray, seed: int) -> np.ndarray:
    """The places at which ``seed`` known words follow each other."""
    ok = np.ones(len(flat), bool)
    for j in range(seed):
        ok &= np.concatenate([flat[j:], np.zeros(j, flat.dtype)]) > 0
    return np.flatnonzero(ok)


def passage_blocks(rows: Iterable[tuple[int, str]], block_words: int | None = None) -> Iterator[Tests]:
    """Passages in blocks, those of one and two words apart; passages without words are left out."""
    most = block_words or BLOCK_WORDS
    open_: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
    size: dict[int, int] = defaultdict(int)
    for i, p in rows:
        w = words(p)
        if not w:
            continue
        seed = min(SEED, len(w))
        if size[seed] and size[seed] + len(w) > most:
            yield _block(open_.pop(seed), seed)
            size[seed] = 0
        open_[seed].append((i, w))
        size[seed] += len(w)
    for seed, b in sorted(open_.items()):
        yield _block(b, seed)


def _block(passages: list[tuple[int, list[str]]], seed: int) -> Tests:
    vocabulary: dict[str, int] = {}
    flat: list[int] = []
    starts = []
    for _, w in passages:
        starts.append(len(flat))
        flat += [vocabulary.setdefault(x, len(vocabulary) + 1) for x in w] + [0]
    return Tests([i for i, _ in passages], vocabulary, np.array(flat, np.int32), np.array(starts), seed)


class SuffixArray:
    """The places of a shard at which ``seed`` known words begin, in the order of the words from there on.

    Suffixes end before the first unknown word; they are told apart up to
    ``depth`` words, the length of the longest passage.
    """

    def __init__(self, flat: np.ndarray, base: int, seed: int = SEED, depth: int = 1 << 30) -> None:
        self.flat, self.base, self.seed, self.depth = flat, base, seed, depth
        # words that one sort column packs into 63 bits
        self.width = max(seed, min(8, int(62 / math.log2(max(base, 2)))))
        at = _begins(flat, seed)
        key = _pack(flat, at, self.width, base)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        self.gram = key // base ** (self.width - seed)
        # groups that agree so far are sorted by their next column, until none is left
        head = np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
        goes_on, done = key % base > 0, self.width
        while done < depth:
            group = np.cumsum(head) - 1
            live = np.flatnonzero((np.bincount(group)[group] > 1) & goes_on) if len(group) else group
            if not len(live):
                break
            g, k = group[live], _pack(flat, at[live] + done, self.width, base)
            o = np.lexsort((k, g))
            at[live], k = at[live[o]], k[o]
            head[live[1:]] |= (k[1:] != k[:-1]) & (g[1:] == g[:-1])
            goes_on[live] = k % base > 0
            done += self.width
        self.places = at
        self.least = [self._common(at[:-1], flat, at[1:])] if len(at) > 1 else [np.zeros(0, np.int64)]
        # least[j][i]: the least common prefix of neighbours i..i+2^j
        while len(self.least[-1]) > (1 << (len(self.least) - 1)):
            a, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(a[:-step], a[step:]))

    def _word(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at < len(flat), flat[np.minimum(at, len(flat) - 1)], 0)

    def _common(self, p: np.ndarray, other: np.ndarray, q: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
        """Known words from place p and from place q of ``other`` that agree, ``size`` of which are known to."""
        size = np.zeros(len(p), np.int64) if size is None else size.copy()
        live = np.flatnonzero(size < self.depth)
        while len(live):
            a = self._word(self.flat, p[live] + size[live])
            live = live[(a > 0) & (a == self._word(other, q[live] + size[live]))]
            size[live] += 1
            live = live[size[live] < self.depth]
        return size

    def insertion(self, t: Tests, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, before, behind): where each test suffix belongs, and the words it shares with its two neighbours there.

        A binary search that compares only words beyond those which both ends
        of its interval share with the suffix.
        """
        low, high = np.zeros(len(q), np.int64), np.full(len(q), len(self.places), np.int64)
        before, behind = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) // 2
            p = self.places[mid]
            size = self._common(p, t.flat, q[live], np.minimum(before[live], behind[live]))
            less = self._word(self.flat, p + size) < self._word(t.flat, q[live] + size)
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
            before[live] = np.where(less, size, before[live])
            behind[live] = np.where(less, behind[live], size)
            live = live[low[live] < high[live]]
        return low, before, behind

    def _between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least common prefix of the neighbours low..high of each pair; boundless for none."""
        out = np.full(len(low), 1 << 30, np.int64)
        some = high > low
        level = np.frexp((high - low)[some].astype(np.float64))[1] - 1
        a, b = low[some], high[some]
        got = np.empty(len(a), np.int64)
        for j in np.unique(level):
            of = level == j
            got[of] = np.minimum(self.least[j][a[of]], self.least[j][b[of] - (1 << int(j))])
        out[some] = got
        return out

    def matches(self, t: Tests, starts: np.ndarray, chunk: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, behind, m) of runs of documents: rows document, passage, place, test place and words of all their
        matches of at least ``seed`` words that can't be extended to either side, by document, passage and place.
        """
        chunk, docs = chunk or CHUNK_MATCHES, len(starts)
        q = _begins(t.flat, self.seed)
        point, before, behind = self.insertion(t, q)
        hit = np.maximum(before, behind) >= self.seed
        q, point, before, behind = q[hit], point[hit], before[hit], behind[hit]
        low = np.searchsorted(self.gram, _pack(t.flat, q, self.seed, self.base), "left")
        order = np.argsort(low, kind="stable")
        q, point, before, behind, low = (x[order] for x in (q, point, before, behind, low))
        # test suffixes that begin with the same words share an interval of places
        grams, first, tests = np.unique(low, return_index=True, return_counts=True)
        size = np.searchsorted(self.gram, self.gram[grams], "right") - grams
        ranks = np.repeat(grams - np.cumsum(size) + size, size) + np.arange(size.sum())
        of = np.repeat(np.arange(len(grams)), size)
        doc = np.searchsorted(starts, self.places[ranks], "right") - 1
        by_doc = np.argsort(doc, kind="stable")
        ranks, of, doc = ranks[by_doc], of[by_doc], doc[by_doc]
        ends = np.cumsum(np.bincount(doc, tests[of], docs)) if docs else np.zeros(0)
        i = 0
        while i < docs:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + chunk, "right")))
            a, b = np.searchsorted(doc, [i, j])
            k, n = of[a:b], tests[of[a:b]]
            r, d = np.repeat(ranks[a:b], n), np.repeat(doc[a:b], n)
            x = np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
            p, tq = self.places[r], q[x]
            left = (p > 0) & (tq > 0) & (self.flat[p - 1] > 0) & (self.flat[p - 1] == t.flat[tq - 1])
            r, d, x, p, tq = (v[~left] for v in (r, d, x, p, tq))
            ahead = r < point[x]
            words_ = np.where(ahead, np.minimum(before[x], self._between(r, point[x] - 1)), np.minimum(behind[x], self._between(point[x], r)))
            m = np.stack([d, np.searchsorted(t.starts, tq, "right") - 1, p, tq, words_])
            yield i, j, m[:, np.lexsort((m[2], m[1], m[0]))]
            i = j


def align(test: list[int], doc: Iterable[tuple[int, int]], rare: set[int], rule: Rule) -> list[tuple[float, int, int, int, int]]:
    """(score, matched, first, behind, rare words) of the best stretches of ``test`` found in order among (place, word) of a document.

    The first is the best by score; a second follows where that has left out
    too much of the passage: the best that has not.
    """
    where: dict[int, list[int]] = defaultdict(list)
    for j, w in doc:
        if w:
            where[w].append(j)
    best = whole = (0.0, 0, 0, 0, 0)
    live: list[tuple[int, int, float, int, int, int]] = []  # test place, doc place, score, matched, first, rare
    for i, w in enumerate(test):
        r = w in rare
        # what the words left out have used up can't be worth going on with
        live = [c for c in live if c[2] > rule.skip * (i - c[0] - 1)]
        new = []
        for j in where.get(w, ()):
            got = (1.0, 1, i, int(r))
            for pi, pj, s, m, first, rr in live:
                gap = j - pj
                if gap > 0:
                    left_out = i - pi - 1
                    v = s + 1 - rule.skip * left_out - rule.insert * max(0, gap - 1 - left_out)
                    if v > got[0]:
                        got = (v, m + 1, first, rr + r)
            new.append((i, j, *got))
            if got[0] > best[0]:
                best = (got[0], got[1], got[2], i + 1, got[3])
            if got[0] > whole[0] and i + 1 - got[2] >= rule.least and got[1] >= rule.share * (i + 1 - got[2]):
                whole = (got[0], got[1], got[2], i + 1, got[3])
        live += new
    return [best] if whole[0] in (0.0, best[0]) else [best, whole]


def hot_texts(docs: DataFrame, share: float) -> DataFrame:
    """(h, first_id): hash and smallest doc_id of each non-empty text that at least ``share`` of the documents (doc_id, text) have.

    Such texts are at most 1/share, whatever the size of the corpus.
    """
    texts = docs.where(F.col("text") != "").select("doc_id", F.xxhash64("text").alias("h"))
    counts = written(texts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")), "text-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where((F.col("n") > 1) & (F.col("n") >= share * total)).select("h", "first_id")


def shards(batches: Iterator[pd.DataFrame], vocabulary: dict[str, int], shard_words: int) -> Iterator[tuple[list[int], list[bool], list[int], list[int]]]:
    """(ids, counted, starts, word numbers) of shards of the documents of (id, text, counted)."""
    ids: list[int] = []
    counted: list[bool] = []
    flat: list[int] = [0]
    starts: list[int] = []
    get = vocabulary.get
    for b in batches:
        for i, x, c in zip(b.iloc[:, 0], b.iloc[:, 1], b.iloc[:, 2]):
            ids.append(i)
            counted.append(bool(c))
            starts.append(len(flat))
            flat.extend([get(a, 0) for a in words(x)])
            flat.append(0)
            if len(flat) >= shard_words:
                yield ids, counted, starts, flat
                ids, counted, flat, starts = [], [], [0], []
    if ids:
        yield ids, counted, starts, flat


def quotations(m: np.ndarray, t: Tests, starts: np.ndarray, flat: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(quoted, own): which places of documents hold a quoted word, and how many places of a quotation each match of ``m`` adds.

    A run of matches of one passage, ``rule.near`` words apart at most, is a
    quotation if it covers as many words as a stretch needs (or the whole of a
    shorter passage) and most of its own length. Places that more than
    ``rule.shared`` different passages cover are a common formula; repeated
    passages are one. Words between and beside the matches of a quotation with
    places of its own are quoted too, as touched-up words may part them.
    Words of more passages than may have a quoted word aren't quoted.
    """
    n = len(flat)
    if not m.shape[1]:
        return np.zeros(n, bool), np.zeros(0, np.int64)
    pair = m[0] * len(t.ids) + m[1]
    end = m[2] + m[4]
    # the furthest end before each match of its pair
    reach = np.cumsum(np.concatenate([[0], np.diff(pair) != 0])) * (n + 1)
    reached = np.concatenate([[-1], np.maximum.accumulate(reach + end)[:-1]]) - reach
    head = np.concatenate([[True], np.diff(pair) != 0]) | (m[2] > reached + rule.near)
    start = np.where(head, m[2], np.maximum(m[2], reached))
    new = np.maximum(end - start, 0)
    first = np.flatnonzero(head)
    run = np.cumsum(head) - 1
    covered = np.add.reduceat(new, first)
    span = np.maximum.reduceat(end, first) - m[2][first]
    whole = t.sizes
    need = np.minimum(rule.share * rule.least, whole[m[1][first]])
    good = ((covered >= need) & (covered >= rule.dense * span))[run]
    # of passages that are repeated, the first counts
    seen: dict[bytes, int] = {}
    one = np.array([seen.setdefault(t.flat[a : a + k].tobytes(), i) == i for i, (a, k) in enumerate(zip(t.starts, whole))])

    def cover(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1))[:n]

    def places(of: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(of)])
        return np.where(good & (new > 0), upto[end] - upto[np.minimum(start, end)], 0)

    counted = good & one[m[1]] & (new > 0)
    own = places(cover(start[counted], end[counted]) <= rule.shared)
    # two short formulas one after the other are none of a passage's own
    short = one[m[1]] & (new > 0)
    alone = np.add.reduceat(places(cover(start[short], end[short]) <= rule.shared), first)
    own = np.where((2 * alone >= need)[run], own, 0)
    # a word that many passages have may be of a short formula and is counted wherever it stands
    base = len(t.vocabulary) + 1
    of = np.repeat(np.arange(len(whole)), whole + 1)
    inside = np.unique((of.astype(np.int64) * base + t.flat)[one[of]])
    few = (np.bincount(inside % base, minlength=base) <= max(rule.shared, rule.shared_part * one.sum()))[flat]
    real = good[first] & (2 * np.add.reduceat(places(few), first) >= need)
    d = m[0][first][real]
    low = np.maximum(m[2][first][real] - rule.near, starts[d])
    high = np.minimum(np.maximum.reduceat(end, first)[real] + rule.near, np.append(starts, n)[d + 1])
    return (cover(low, high) > 0) & few, own


SCANNED = "counts boolean, doc_id long, words array<int>, matches array<int>, word int, n long"
FOUND = "doc_id long, eval_id long, score double, matched int, first_word int, behind_word int, rare int, rare_of int"


def scan(docs: DataFrame, block: Tests, rule: Rule, shard_words: int) -> DataFrame:
    """In one pass over (doc_id, text, counted): the documents with matches, and in how many documents each word stands by shard.

    ``words`` are the document's words as numbers; ``matches`` has passage,
    place, test place, words and own places of each match, one list behind the
    other. A word isn't counted where it is part of a quotation, nor in
    documents that aren't ``counted``; word 0 counts the documents.
    """
    known = docs.sparkSession.sparkContext.broadcast(vars(block))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tests(**known.value)
        base = len(t.vocabulary) + 1
        for ids, counted, starts, words_ in shards(batches, t.vocabulary, shard_words):
            flat, begin, ok = np.array(words_, np.int32), np.array([*starts, len(words_)]), np.array(counted)
            c = np.zeros(base, np.int64)
            c[0] = ok.sum()
            found = []
            for i, j, m in SuffixArray(flat, base, t.seed, int(t.sizes.max())).matches(t, begin[:-1]):
                low, high = begin[i], begin[j]
                part, start = flat[low:high], begin[i:j] - low
                m = m - np.array([[i], [0], [low], [0], [0]])
                quoted, own = quotations(m, t, start, part, rule)
                at = np.flatnonzero((part > 0) & ~quoted)
                of = np.searchsorted(start, at, "right") - 1
                inside = np.unique((of * base + part[at])[ok[i:j][of]])
                c += np.bincount(inside % base, minlength=base)
                cut = np.searchsorted(m[0], np.arange(j - i + 1))
                for d in np.unique(m[0]):
                    a, b = cut[d], cut[d + 1]
                    a0, a1 = start[d], begin[i + d + 1] - low
                    mine = np.stack([m[1, a:b], m[2, a:b] - a0, m[3, a:b], m[4, a:b], own[a:b]])
                    found.append((False, ids[i + d], part[a0 : a1 - 1], mine.astype(np.int32).ravel(), None, None))
            some = np.flatnonzero(c)
            rows = [*found, *((True, None, None, None, w, n) for w, n in zip(some.tolist(), c[some].tolist()))]
            yield pd.DataFrame(rows, columns=["counts", "doc_id", "words", "matches", "word", "n"]).astype({"doc_id": "Int64", "word": "Int32", "n": "Int64"})

    return docs.mapInPandas(run, SCANNED)


def leaked(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text", eval_id: str = "eval_id", passage: str = "passage", rule: Rule = Rule(), shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, eval_id, score, matched, first_word, behind_word, rare, rare_of): the leaked stretches, one row per document and test item.

    Words are compared without case, accents, look-alikes, unseen characters
    and punctuation. The stretch reaches from ``first_word`` of the passage to
    before ``behind_word``. Null and empty texts and passages leak nothing;
    passages shorter than ``rule.least`` words leak if all their words stand in
    a document in order, ``SEED`` of them or all side by side somewhere.
    Repeated documents give a row for each doc_id, repeated passages one for
    each eval_id. No passages or no documents: an empty result.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # copies that alone would make their words common count once
    hot = hot_texts(d, rule.rare_part / 4)
    tagged = d.withColumn("h", F.xxhash64("text")).join(F.broadcast(hot), "h", "left")
    tagged = tagged.select("doc_id", "text", (F.length("text") > 0).alias("filled"), F.coalesce(F.col("first_id") == F.col("doc_id"), F.lit(True)).alias("only"))
    tagged = tagged.select("doc_id", "text", F.coalesce(F.col("filled") & F.col("only"), F.lit(False)).alias("counted"))
    held = passages.select(eval_id, passage).where(F.col(passage) != "")
    out = None
    # one partition of the passages at a time reaches the driver, one block of them every task
    for block in passage_blocks((r[0], r[1]) for r in held.toLocalIterator()):
        scanned = written(scan(tagged, block, rule, shard_words), "leak-scan", partition_by=["counts"])
        # as many rows as the block has words
        counts = {r["word"]: r["n"] for r in scanned.where("counts").groupBy("word").agg(F.sum("n").alias("n")).collect()}
        most = max(rule.rare_least, rule.rare_part * counts.pop(0, 0))
        rare = np.ones(len(block.vocabulary) + 1, bool)
        rare[[0, *(w for w, n in counts.items() if n > most)]] = False
        # plain values, as a broadcast names the classes in it by their module
        shared = spark.sparkContext.broadcast((vars(block) | {"vocabulary": {}}, rare))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            parts, known_rare = shared.value
            t = Tests(**parts)
            search = Stretches(t, known_rare, rule)
            for b in batches:
                rows = [row for i, w, m in zip(b["doc_id"], b["words"], b["matches"]) for row in search.of(int(i), np.asarray(w), np.asarray(m).reshape(5, -1))]
                yield pd.DataFrame(rows, columns=["doc_id", "eval_id", "score", "matched", "first_word", "behind_word", "rare", "rare_of"])

        found = scanned.where(~F.col("counts")).select("doc_id", "words", "matches").mapInPandas(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], FOUND)


class Stretches:
    """The leaked stretches of one document after the other."""

    def __init__(self, t: Tests, rare: np.ndarray, rule: Rule) -> None:
        self.t, self.rule, self.sizes = t, rule, t.sizes
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.seldom, self.rare = rare, set(np.flatnonzero(rare).tolist()) - {0}
        self.before = np.concatenate([[0], np.cumsum(rare[t.flat])])

    def of(self, doc_id: int, words_: np.ndarray, m: np.ndarray) -> Iterator[tuple]:
        """Rows of ``FOUND`` of a document by its words and matches (passage, place, test place, words, own places)."""
        rule = self.rule
        rare = self.before[m[2] + m[3]] - self.before[m[2]]
        head = np.flatnonzero(np.diff(m[0], prepend=-1))
        # pairs without a rare word need a quotation; passages shorter than a stretch need neither
        whole = self.sizes[m[0, head]]
        may = (np.add.reduceat(rare, head) > 0) | (np.add.reduceat(m[4], head) >= np.minimum(rule.least, whole)) | (whole < rule.least)
        ends = np.append(head[1:], m.shape[1])
        for a, b in zip(head[may].tolist(), ends[may].tolist()):
            e = int(m[0, a])
            # parts of the document so far from each other that no stretch outweighs what lies between
            reach = int(self.sizes[e]) / rule.insert
            cuts, end = [a], int(m[1, a] + m[3, a])
            for k in range(a + 1, b):
                if m[1, k] > end + reach:
                    cuts.append(k)
                end = max(end, int(m[1, k] + m[3, k]))
            best = max((got for x, y in zip(cuts, [*cuts[1:], b]) for got in self._stretches(e, words_, m[:, x:y], int(rare[x:y].sum()))), default=None)
            if best is not None:
                yield (doc_id, int(self.t.ids[e]), *best)

    def _words(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words of a passage, and how often each stands there."""
        if e not in self.known:
            at = int(self.t.starts[e])
            self.known[e] = np.unique(self.t.flat[at : at + int(self.sizes[e])], return_counts=True)
        return self.known[e]

    def _stretches(self, e: int, words_: np.ndarray, m: np.ndarray, rare: int) -> Iterator[tuple]:
        """(score, matched, first, behind, rare, rare_of) of the stretches that count as leaked."""
        rule, at, whole = self.rule, int(self.t.starts[e]), int(self.sizes[e])
        quoted = int(m[4].sum())
        if not rare and quoted < min(rule.least, whole) and whole >= rule.least:
            return
        spans: list[list[int]] = []
        for p, n in zip(m[1].tolist(), m[3].tolist()):
            if spans and p - rule.beside <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], p + n + rule.beside)
            else:
                spans.append([max(p - rule.beside, 0), p + n + rule.beside])
        places = np.concatenate([np.arange(x, min(y, len(words_))) for x, y in spans])
        distinct, times = self._words(e)
        spot = np.minimum(np.searchsorted(distinct, words_[places]), len(distinct) - 1)
        in_both = distinct[spot] == words_[places]
        places, spot = places[in_both], spot[in_both]
        both = np.minimum(times, np.bincount(spot, minlength=len(distinct)))
        shared, seldom = int(both.sum()), int(both[self.seldom[distinct]].sum())
        if shared < min(whole, max(rule.score, rule.share * rule.least)):
            return
        if whole >= rule.least and quoted < rule.least and (shared < rule.sure if seldom < rule.rare else seldom < 1):
            return
        for score, matched, first, behind, r in align(self.t.flat[at : at + whole].tolist(), zip(places.tolist(), words_[places].tolist()), self.rare, rule):
            span, of = behind - first, int(self.before[at + behind] - self.before[at + first])
            if whole < rule.least:
                ok = matched == whole
            else:
                ok = span >= rule.least and matched >= rule.share * span and score >= rule.score
                own = quoted >= rule.least and (matched == span or score >= rule.sure)
                ok = ok and (own or (r >= (min(rule.rare, 1) if score >= rule.sure else rule.rare) and r >= rule.rare_share * of))
            if ok:
                yield float(score), matched, first, behind, r, of


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that leak nothing."""
    return docs.join(found.select(F.col("doc_id").alias("__leaks")).distinct(), F.col(doc_id) == F.col("__leaks"), "left_anti")
