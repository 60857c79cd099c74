"""One form for texts that look the same.

Tokens stand between plain spaces, tabs and line breaks; other spaces count as
plain ones. The plain spellings of the corpus form a vocabulary. Tokens that
hold look-alikes, unseen characters, decomposed accents or width and font
variants are suspects: each is run through a trie of the vocabulary by an
automaton with weighted edits, to which look-alikes and unseen characters cost
nothing. The spelling that it reaches is the token's canonical one; a token
that reaches none is normalised by the table of shapes.

Canonical spellings depend only on what a token looks like, so two texts look
the same exactly if their canonical texts are equal.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import rows_with_keys
from ..session import written
from .looks import CYRILLIC, GREEK, LATIN, MARKS, SPACES, ignorable, shape, skeleton

#: Suspects and their part of the vocabulary that one trie is meant to hold.
TRIE_TOKENS = 20_000
#: A token in at least 1/HOT_SHARE of all suspect places is hot: there are at most HOT_SHARE such tokens.
HOT_SHARE = 1000
#: Tasks over which the documents of a hot text are spread.
SALTS = 32
_SEPARATORS = re.compile(r"(\s+)")
_PLAIN_SPACES = str.maketrans(dict.fromkeys(SPACES, " "))


def _script(ch: str) -> str | None:
    """Script of a letter, as far as look-alikes matter."""
    if ch.isascii():
        return "latin" if ch.isalpha() else None
    c = ord(ch)
    if 0x400 <= c <= 0x52F:
        return "cyrillic"
    if 0x370 <= c <= 0x3FF:
        return "greek"
    return "latin" if unicodedata.category(ch)[0] == "L" and c < 0x250 else None


def _inverse(table: dict[str, str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for c, latin in table.items():
        out.setdefault(latin, c)
    return out


def _alike() -> dict[str, str]:
    out: dict[str, str] = {}
    for table in (CYRILLIC, GREEK, LATIN, MARKS):
        for c, plain in table.items():
            out[plain] = out.get(plain, plain) + c
    return out


#: The characters of plain spellings that look like each shape, itself included.
ALIKE = _alike()
_BACK = {"cyrillic": _inverse(CYRILLIC), "greek": _inverse(GREEK)}
_AMBIGUOUS = {latin for back in _BACK.values() for latin in back}


def table_form(token: str) -> str:
    """The token by the table alone, the same for all tokens that look like it.

    Look-alikes become Latin, unless letters that stand only in Cyrillic or
    only in Greek show that the word is written in that script.
    """
    plain = skeleton(token)
    if plain.isascii():
        return plain
    scripts = {s for c in unicodedata.normalize("NFD", plain) if c not in _AMBIGUOUS and (s := _script(c))}
    if len(scripts) == 1 and (back := _BACK.get(next(iter(scripts)))):
        plain = unicodedata.normalize("NFC", "".join(back.get(c, c) for c in unicodedata.normalize("NFD", plain)))
    return plain


def is_suspect(token: str) -> bool:
    """Whether a token has another canonical spelling, or may have one."""
    if token.isascii():
        return False
    if table_form(token) != token:
        return True
    return False


class Trie:
    """Spellings by their characters, decomposed. A node is a dict; the spellings that end at it stand at the key ''."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, spelling: str, count: int) -> None:
        node = self.root
        for c in spelling if spelling.isascii() else unicodedata.normalize("NFD", spelling):
            node = node.setdefault(c, {})
        node.setdefault("", []).append((spelling, count))

    def search(self, token: str, most: float = 0.0, substitute: float = 1.0, insert: float = 1.0, delete: float = 1.0) -> list[tuple[float, str, int]]:
        """(cost, spelling, count) of all spellings within ``most`` of a token.

        The automaton's states are pairs of a node and the least cost of
        reaching it. A character goes along every edge that looks like it for
        nothing, and an unseen one stays for nothing; a visible one may be
        replaced, left out, or one put in, at their costs. Canonical spellings
        are those at no cost, as any visible difference counts.
        """

        def close(states: dict[int, tuple[float, dict]]) -> dict[int, tuple[float, dict]]:
            todo = list(states.values())
            while todo:
                cost, node = todo.pop()
                if cost + insert <= most:
                    for c, nxt in node.items():
                        if c and (id(nxt) not in states or cost + insert < states[id(nxt)][0]):
                            states[id(nxt)] = (cost + insert, nxt)
                            todo.append((cost + insert, nxt))
            return states

        states = close({id(self.root): (0.0, self.root)})
        for c in visible(token):
            for unit in shape(c):
                nxt: dict[int, tuple[float, dict]] = {}

                def put(cost: float, node: dict) -> None:
                    if cost <= most and (id(node) not in nxt or cost < nxt[id(node)][0]):
                        nxt[id(node)] = (cost, node)

                for cost, node in states.values():
                    for edge in ALIKE.get(unit, unit):
                        if (same := node.get(edge)) is not None:
                            put(cost, same)
                    if most:
                        put(cost + delete, node)
                        for edge, other in node.items():
                            if edge:
                                put(cost + substitute, other)
                states = close(nxt) if most else nxt
                if not states:
                    return []
        return sorted((cost, s, n) for cost, node in states.values() for s, n in node.get("", ()))


def visible(token: str) -> str:
    """The characters that are drawn, decomposed, marks in canonical order."""
    if token.isascii():
        return token
    return unicodedata.normalize("NFD", "".join(c for c in unicodedata.normalize("NFD", token) if not ignorable(c)))


def spelling_shapes(token: str) -> str:
    """What the automaton reads: the shapes of a token's characters; unseen ones have none."""
    if token.isascii():
        return token
    return unicodedata.normalize("NFD", "".join(map(shape, unicodedata.normalize("NFD", token))))


def choose(found: list[tuple[float, str, int]], token: str) -> str:
    """The canonical spelling: the least cost, then ASCII before others, then the most frequent, then the first."""
    if not found:
        return table_form(token)
    return min(found, key=lambda f: (f[0], not f[1].isascii(), -f[2], f[1]))[1]


def block_of(token: str) -> tuple[str, int]:
    """(block, spot) of a token, equal for tokens that look the same.

    The block is the first two shapes and the number of shapes; it tells which
    part of the vocabulary suspects can reach. The spot spreads tokens evenly,
    however many share a block.
    """
    s = spelling_shapes(token)
    return f"{s[:2]}{len(s)}", zlib.crc32(s.encode("utf-8", "surrogatepass"))


_SCAN = "suspect boolean, doc_id long, text string, tokens array<string>, token string, block string, spot long, n long"


def scan_tokens(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """In one pass: the documents that hold suspects, with them, and the counts of the others' vocabulary by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, bool] = {}
        for b in batches:
            counts: Counter[str] = Counter()
            rows = []
            for i, t in zip(b.iloc[:, 0], b.iloc[:, 1]):
                if not t:
                    continue
                t = t.translate(_PLAIN_SPACES) if not t.isascii() else t
                tokens = Counter(t.split())
                bad = []
                for w, n in tokens.items():
                    if w.isascii():
                        counts[w] += n
                        continue
                    s = known.get(w)
                    if s is None:
                        if len(known) > 500_000:
                            known.clear()
                        s = known[w] = is_suspect(w)
                    if s:
                        bad.append(w)
                    else:
                        counts[w] += n
                if bad:
                    rows.append((True, i, t, bad, None, None, None, None))
            rows += [(False, None, None, None, w, *block_of(w), n) for w, n in counts.items()]
            out = pd.DataFrame(rows, columns=["suspect", "doc_id", "text", "tokens", "token", "block", "spot", "n"])
            yield out.astype({"doc_id": "Int64", "spot": "Int64", "n": "Int64"})

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, _SCAN)


def split_tokens(text: str) -> list[str]:
    """Tokens and what stands between them, in turn."""
    return _SEPARATORS.split(text)


def spellings(suspects: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, canonical) of each distinct suspect, by tries of the vocabulary.

    Both have (token, block, spot), the vocabulary also n. Blocks that no
    suspect lies in are left out before anything is built. Tokens are spread
    over tries of about ``TRIE_TOKENS`` by their spots, so no trie grows with
    the vocabulary; tokens that look the same meet in one. Each task builds its
    trie once and runs its suspects through it.
    """
    blocks = suspects.select("block").distinct()
    near = vocabulary.join(blocks, "block", "left_semi").groupBy("token", "spot").agg(F.sum("n").alias("n")).withColumn("suspect", F.lit(False))
    both = written(near.unionByName(suspects.select("token", "spot", F.lit(0).cast("long").alias("n"), F.lit(True).alias("suspect"))), "trie-tokens")
    groups = max(1, both.count() // TRIE_TOKENS)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        plain = rows[~rows["suspect"]]
        for w, n in zip(plain["token"], plain["n"]):
            trie.add(w, int(n))
        tokens = rows.loc[rows["suspect"], "token"].tolist()
        return pd.DataFrame({"token": tokens, "canonical": [choose(trie.search(t), t) for t in tokens]})

    return both.withColumn("bucket", F.pmod("spot", F.lit(groups))).groupBy("bucket").applyInPandas(run, "token string, canonical string")


def rewrite(affected: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, text): the affected documents (doc_id, text) with their tokens replaced by (doc_id, token, canonical)."""
    per_doc = pairs.groupBy("doc_id").agg(F.collect_list("token").alias("old"), F.collect_list("canonical").alias("new"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, old, new in zip(b["text"], b["old"], b["new"]):
                m = dict(zip(old, new)) if old is not None else {}
                out.append("".join([m.get(w, w) for w in split_tokens(t)]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": out})

    return affected.join(per_doc, "doc_id", "left").select("doc_id", "text", "old", "new").mapInPandas(run, "doc_id long, text string")


def canonical_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(changed, spellings): canonical texts of the documents that hold suspects, and (token, canonical).

    Every other document is its own canonical text but for its spaces. Null
    and empty texts hold nothing.
    """
    scanned = written(scan_tokens(docs, doc_id, text), "tokens", partition_by=["suspect"])
    affected = scanned.where(F.col("suspect")).select("doc_id", "text", "tokens")
    vocabulary = scanned.where(~F.col("suspect")).select("token", "block", "spot", "n")
    block = F.pandas_udf(_blocks, "block string, spot long")
    places = affected.select("doc_id", F.explode("tokens").alias("token"))
    suspects = written(places.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("b", block("token")).select("token", "n", "b.block", "b.spot"), "suspects")
    table = written(spellings(suspects, vocabulary).join(suspects.select("token", "n"), "token"), "spellings")
    total = table.agg(F.sum("n")).first()[0] or 0
    bound = max(1.0, total / HOT_SHARE)
    hot = F.broadcast(table.where(F.col("n") >= bound).select("token", "canonical"))
    cold = table.where(F.col("n") < bound).select("token", "canonical")
    pairs = places.join(hot, "token").unionByName(places.join(hot, "token", "left_anti").join(cold, "token"))
    return rewrite(affected.select("doc_id", "text"), pairs.select("doc_id", "token", "canonical")), table.select("token", "canonical")


def _blocks(tokens: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([block_of(t) for t in tokens], columns=["block", "spot"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, exact, canon): hashes of each non-empty text as it is and in canonical form."""
    changed, _ = canonical_texts(docs, doc_id, text)
    h = lambda c: F.unhex(F.md5(F.encode(c, "UTF-8")))
    own = docs.where(F.col(text) != "").select(F.col(doc_id).alias("doc_id"), h(F.col(text)).alias("exact"), h(F.translate(text, SPACES, " " * len(SPACES))).alias("same"))
    new = changed.select("doc_id", h(F.col("text")).alias("new"))
    return own.join(new, "doc_id", "left").select("doc_id", "exact", F.coalesce("new", "same").alias("canon"))


def _spread(members: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """Members (doc_id, exact) with a salt: those of hot texts (exact, n), at most ``HOT_SHARE`` by arithmetic, take one of ``SALTS``."""
    hot = texts.where(F.col("n") >= max(2.0, total / HOT_SHARE)).select("exact", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")
    return members.join(F.broadcast(hot), "exact", "left").withColumn("salt", salt).drop("hot")


def _salts(total: int) -> Column:
    """A row per salt that members of a text with n documents have."""
    return F.explode(F.when(F.col("n") >= max(2.0, total / HOT_SHARE), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")


def _texts(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(prints, texts): fingerprints, and (canon, exact, n, first) of each different text."""
    prints = written(fingerprints(docs, doc_id, text), "fingerprints")
    return prints, written(prints.groupBy("canon", "exact").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")), "texts")


def same_looks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: documents that look the same but differ in code points.

    Documents with one text are grouped first, so copies meet only as members
    of different texts: a text that a third of all documents share makes no
    pairs with itself, and its members are spread over many tasks where they
    meet those of others. A doc_id is unique; null and empty texts make no
    pairs. Every pair comes out; ``class_links`` and ``class_members`` have the
    same in a row per text and per document.
    """
    prints, texts = _texts(docs, doc_id, text)
    several = written(texts.groupBy("canon").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).where(F.col("texts") > 1), "several")
    total = texts.agg(F.sum("n")).first()[0] or 0
    some = written(rows_with_keys(texts, several, "canon", "n", total).select("canon", "exact", "n"), "different")
    members = written(rows_with_keys(prints, several, "canon", "n", total).select("doc_id", "exact"), "members")
    a, b = some.select("canon", F.col("exact").alias("a"), F.col("n").alias("n_a")), some.select("canon", F.col("exact").alias("b"), F.col("n").alias("n_b"))
    pairs = a.join(b, "canon").where(F.col("a") < F.col("b"))
    spread = _spread(members, some, total)
    left = pairs.select(F.col("a").alias("exact"), F.col("n_a").alias("n"), "b", "n_b").select("*", _salts(total))
    half = left.join(spread.withColumnRenamed("doc_id", "x"), ["exact", "salt"]).select("x", F.col("b").alias("exact"), F.col("n_b").alias("n"))
    both = half.select("*", _salts(total)).join(spread.withColumnRenamed("doc_id", "y"), ["exact", "salt"])
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def _classes(texts: DataFrame) -> DataFrame:
    """(exact, n, exact_id, class_id, links) of each different text."""
    classes = texts.groupBy("canon").agg(F.min("first").alias("class_id"), F.sum("n").alias("all"))
    return texts.join(classes, "canon").select("exact", "n", F.col("first").alias("exact_id"), "class_id", (F.col("all") - F.col("n")).alias("links"))


def class_members(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, exact_id, copies, links): one row per non-empty document.

    ``class_id`` is the smallest doc_id of all that look the same, ``exact_id``
    the smallest with this very text, ``copies`` the documents with this text
    and ``links`` those that look the same but differ in code points: documents
    of one class with different exact_ids are the pairs of ``same_looks``.
    """
    prints, texts = _texts(docs, doc_id, text)
    total = texts.agg(F.sum("n")).first()[0] or 0
    spread = _spread(prints.select("doc_id", "exact"), texts, total)
    return spread.join(_classes(texts).select("*", _salts(total)), ["exact", "salt"]).select("doc_id", "class_id", "exact_id", F.col("n").alias("copies"), "links")


def class_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b): the class's representative and the first document of each other text of the class."""
    _, texts = _texts(docs, doc_id, text)
    return _classes(texts).where(F.col("class_id") != F.col("exact_id")).select(F.col("class_id").alias("doc_id_a"), F.col("exact_id").alias("doc_id_b"))
