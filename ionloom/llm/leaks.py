"""Evaluation passages inside a corpus, found through a positional inverted index.

The index holds the places of every term of the corpus, whatever will be sought: a row per term and block of
documents, stored in the shared folder clustered by term. A search reads only the lists it needs: of every run
of ``min_words`` terms of an item those of its rarest terms, by their numbers in the index. The lists are
shifted by the terms' offsets and intersected; documents where they meet are then read in whole. With
``slack`` 0 the words must stand consecutively (a phrase); with more, each may be off its place by so many
words (proximity). Another set of items asks the same index.

Defined results: null and empty texts hold nothing; items with fewer than ``min_words`` words are never
found; a document is reported once per item, whatever its number of passages; documents and items are
read whole; a hyphen at a line end joins its two parts if the joined word is a word of the items (the index
has both readings); several texts of one item_id are one item, several of one doc_id one document.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.runtime import BROADCAST_BYTES, measured, sized_join, stored

MIN_WORDS = 12
#: Documents and characters after which a block of postings leaves the task that reads it.
BLOCK_DOCS, BLOCK_CHARS = 10_000, 16_000_000
#: Parts over which the list of one term is spread, so that a common term isn't one task's.
SALTS = 64
#: Words among which the words split at line ends are counted; passages looked for are at most half as long.
SPAN = 64

WORD = re.compile(r"[^\W_]+")
# Code points that are not seen (soft hyphen, joiners, zero widths, marks, selectors, tags).
UNSEEN = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF)]
INVISIBLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSEEN) + "]")
SOFT = chr(0xAD)
HYPHENS = "-" + SOFT + "".join(map(chr, range(0x2010, 0x2014)))
BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|blockquote|pre)\b[^<>]*>", re.I)
TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
MARKDOWN = re.compile(r"\*\*|__|~~|\]\([^)\s]*\)|\\[A-Za-z]+\{")
SPLIT_WORD = re.compile(rf"([^\W_]+)[{HYPHENS}][^\S\n]*\r?\n[\s>|]*([^\W_]+)")


# Stands between the parts of a split word until it is decided how they are read; no word holds it.
SEAM = chr(0xE000)


def normalised(text: str, vocabulary=None, seams: bool = False) -> str:
    """``text`` without what makes no difference to its words, in folded case. The parts of a word split at a
    line end are joined if ``vocabulary`` has the joined word (or is None); with ``seams`` that stays open."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub("", BLOCK_TAG.sub(" ", text))
    plain = text.isascii()
    if not plain:
        # Soft hyphens at line ends split words as other hyphens do, so they go only afterwards.
        text = unicodedata.normalize("NFKC", text.replace(SEAM, " "))
        text = INVISIBLE.sub(lambda m: SOFT if m.group() == SOFT else "", text)
    text = MARKDOWN.sub("", text).casefold()
    if "\n" in text:

        def join(m: re.Match) -> str:
            whole = INVISIBLE.sub("", m.group(1) + m.group(2))
            return m.group(1) + SEAM + m.group(2) if seams else whole if vocabulary is None or whole in vocabulary else m.group(1) + " " + m.group(2)

        text = SPLIT_WORD.sub(join, text)
    if not plain:
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return text


def words(text: str, vocabulary=None) -> list[str]:
    return WORD.findall(normalised(text, vocabulary))


def both_readings(text: str) -> tuple[list[str], list[tuple[int, str]]]:
    """The words of ``text`` with split words apart, and each split word joined, at the place of its first part."""
    text = normalised(text, seams=True)
    if SEAM not in text:
        return WORD.findall(text), []
    out, joined = [], []
    for m in SEAMED.finditer(text):
        parts = m.group().split(SEAM)
        joined += [(len(out) + i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        out += parts
    return out, joined


SEAMED = re.compile(rf"[^\W_]+(?:{SEAM}[^\W_]+)*")


@lru_cache(maxsize=1 << 16)
def term_of(word: str) -> int:
    """64 bits that stand for a word."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


INDEX = "term long, block long, splits int, n int, doc_ids array<long>, positions array<int>"


def postings(docs: list[tuple[int, str]], block: int) -> Iterator[pa.RecordBatch]:
    """Rows of INDEX for a block of documents: every term with the places where it stands."""
    number: dict[str, int] = {}
    ids, lens, flat, extra, splits = [], [], [], [], 0
    for k, (doc_id, text) in enumerate(docs):
        tokens, joined = both_readings(text)
        flat.append(np.array([number.setdefault(w, len(number)) for w in tokens], dtype=np.int32))
        ids.append(doc_id)
        lens.append(len(tokens))
        if joined:
            at = np.array([p for p, _ in joined])
            splits = max(splits, int((np.searchsorted(at, at + SPAN) - np.arange(len(at))).max()))
            extra += [(k, p, number.setdefault(w, len(number))) for p, w in joined]
    total = sum(lens)
    if not total:
        return
    term = np.concatenate([*flat, np.array([t for _, _, t in extra], dtype=np.int32)])
    doc = np.concatenate([np.repeat(np.arange(len(ids)), lens), np.array([k for k, _, _ in extra], dtype=np.int64)])
    place = np.concatenate([np.arange(total) - np.repeat(np.r_[0, np.cumsum(lens)[:-1]], lens), np.array([p for _, p, _ in extra], dtype=np.int64)])
    order = np.argsort(term, kind="stable")
    term = term[order]
    doc_ids, place = pa.array(np.array(ids, dtype=np.int64)[doc[order]]), pa.array(place[order].astype(np.int32))
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    ends = np.r_[starts[1:], len(term)]
    hashes = np.array([term_of(w) for w in number], dtype=np.int64)[term[starts]]
    for i in range(0, len(starts), 10_000):
        j = min(i + 10_000, len(starts))
        offs = pa.array(np.r_[starts[i:j], ends[j - 1]].astype(np.int32))
        n = j - i
        cols = [pa.array(hashes[i:j]), pa.array(np.full(n, block, dtype=np.int64)), pa.array(np.full(n, splits, dtype=np.int32)), pa.array((ends[i:j] - starts[i:j]).astype(np.int32)), pa.ListArray.from_arrays(offs, doc_ids), pa.ListArray.from_arrays(offs, place)]
        yield pa.RecordBatch.from_arrays(cols, names=["term", "block", "splits", "n", "doc_ids", "positions"])


def build_index(documents: DataFrame) -> DataFrame:
    """The stored index of a corpus, whatever will be sought in it: (term, block, splits, n, doc_ids, positions),
    a row per term and block of documents, clustered by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, block, chars = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                block.append((doc_id, text))
                chars += len(text)
                if len(block) >= BLOCK_DOCS or chars >= BLOCK_CHARS:
                    yield from postings(block, (part << 32) + no)
                    no, block, chars = no + 1, [], 0
        if block:
            yield from postings(block, (part << 32) + no)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text <> ''")
    rows = docs.mapInArrow(run, INDEX)
    return stored(rows.repartition("term", F.pmod("block", F.lit(SALTS))).sortWithinPartitions("term"))


def rarest(terms: list[int], numbers: dict[int, int], min_words: int) -> dict[tuple[int, int], list[int]]:
    """The places of the rarest and the second rarest term of every run of an item that the corpus can hold, with
    the runs' own places."""
    size = [numbers.get(t, 0) for t in terms]
    out: dict[tuple[int, int], list[int]] = {}
    for k in range(len(terms) - min_words + 1):
        run = range(k, k + min_words)
        if min(size[i] for i in run) > 0:
            first, second = (sorted(run, key=lambda i: (size[i], i)) * 2)[:2]
            out.setdefault((first, second), []).append(k)
    return out


def candidates(index: DataFrame, items: list[list[int]], min_words: int, slack: int) -> tuple[DataFrame, list[tuple[int, list[int]]]]:
    """(doc_id, pair), and for each pair its item's number and its runs' places: documents where the two rarest terms
    of some runs stand as far apart as in the item, but for ``slack`` and the words that may be read as one or two.

    The list of the rarest term says in which documents, and where, the second one is to be looked for; of that
    one's list only those documents' places are kept. What is broadcast is made of the items, whose size was
    measured."""
    spark = index.sparkSession
    wanted = F.broadcast(spark.createDataFrame(sorted({(t,) for ts in items for t in ts}), "term long"))
    numbers = {r.term: r.n for r in index.select("term", "n").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    pairs = [(n, ts[a], a, ts[b], b, ks) for n, ts in enumerate(items) for (a, b), ks in sorted(rarest(ts, numbers, min_words).items())]
    first = F.broadcast(spark.createDataFrame([(t, p, u, b - a) for p, (_, t, a, u, b, _) in enumerate(pairs)], "term long, pair int, second long, apart int"))
    seconds = F.broadcast(spark.createDataFrame(sorted({(p[3],) for p in pairs}), "term long"))
    splits = F.col("splits") if 2 * min_words <= SPAN else F.when(F.col("splits") > 0, F.lit(min_words)).otherwise(F.lit(0))
    hits = index.join(first, "term").select("pair", "second", "apart", splits.alias("splits"), F.explode(F.arrays_zip("doc_ids", "positions")).alias("p"))
    asked = hits.select(F.col("p.doc_ids").alias("doc_id"), F.col("second").alias("term"), "pair", (F.col("p.positions") + F.col("apart")).alias("at"), (F.col("splits") + 2 * slack).alias("off")).distinct()
    places = index.join(seconds, "term").select("term", F.explode(F.arrays_zip("doc_ids", "positions")).alias("p")).select("term", F.col("p.doc_ids").alias("doc_id"), F.col("p.positions").alias("place"))
    met = sized_join(places, asked, ["doc_id", "term"], "inner").filter(F.abs(F.col("place") - F.col("at")) <= F.col("off"))
    return met.select("doc_id", "pair").distinct(), [(p[0], p[5]) for p in pairs]


class Passages:
    """The runs of the items, made once, and whether a text holds some of them."""

    def __init__(self, items: list[list[str]], min_words: int, slack: int):
        self.items, self.min_words, self.slack = items, min_words, slack
        self.vocabulary = {w for ws in items for w in ws}
        self.runs: dict[tuple[int, int], str] = {}
        self.near = np.arange(-slack, slack + 1)

    def run(self, n: int, k: int) -> str:
        got = self.runs.get((n, k))
        if got is None:
            got = self.runs[n, k] = f" {' '.join(self.items[n][k : k + self.min_words])} "
        return got

    def found(self, text: str, wanted: list[tuple[int, list[int]]]) -> set[int]:
        """Items (by number) of which ``text`` holds one of the runs named: in a row, or each word within the slack."""
        tokens = words(text, self.vocabulary)
        out: set[int] = set()
        if not self.slack:
            line = f" {' '.join(tokens)} "
            for n, ks in wanted:
                if n not in out and any(self.run(n, k) in line for k in ks):
                    out.add(n)
            return out
        places: dict[str, list[int]] = {}
        for p, w in enumerate(tokens):
            if w in self.vocabulary:
                places.setdefault(w, []).append(p)
        arrays = {w: np.array(p) for w, p in places.items()}
        for n, ks in wanted:
            if n not in out and any(self._holds(arrays, self.items[n][k : k + self.min_words]) for k in ks):
                out.add(n)
        return out

    def _holds(self, places: dict[str, np.ndarray], run: list[str]) -> bool:
        """The lists, shifted to where the run begins and widened by the slack, meet; the shortest goes first."""
        if not all(w in places for w in run):
            return False
        order = sorted(range(len(run)), key=lambda i: len(places[run[i]]))
        left = np.unique(np.add.outer(places[run[order[0]]] - order[0], self.near))
        for i in order[1:]:
            p = places[run[i]] - i
            at = np.searchsorted(p, left - self.slack)
            left = left[(at < len(p)) & (p[np.minimum(at, len(p) - 1)] <= left + self.slack)]
            if not len(left):
                return False
        return True


def search(index: DataFrame, documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, slack: int = 0, blocks: int | None = None) -> DataFrame:
    """(doc_id, item_id) of every document that holds ``min_words`` words of an item; ``index`` is that of ``documents``.

    Items are read by the driver in as many blocks (by hash) as their measured size needs; each block asks the
    same index. Documents that hold a candidate are then read in whole."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text <> ''")
    blocks = blocks or 1 + measured(items) // (BROADCAST_BYTES // 4)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        texts = [(r.item_id, ws) for r in part.collect() if len(ws := words(r.text)) >= min_words]
        found, runs = candidates(index, [[term_of(w) for w in ws] for _, ws in texts], min_words, slack)
        # At most the block's runs in a list.
        pairs = sized_join(docs, found.groupBy("doc_id").agg(F.collect_list("pair").alias("pairs")), ["doc_id"], "inner").select("doc_id", "text", "pairs")

        def run(batches: Iterator[pa.RecordBatch], texts=texts, runs=runs) -> Iterator[pa.RecordBatch]:
            passages = Passages([ws for _, ws in texts], min_words, slack)
            for batch in batches:
                got = [(doc_id, texts[n][0]) for doc_id, text, wanted in zip(*(c.to_pylist() for c in batch.columns)) for n in passages.found(text, [runs[p] for p in wanted])]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["doc_id", "item_id"])

        got = pairs.mapInArrow(run, "doc_id long, item_id long").distinct()
        out = got if out is None else out.unionByName(got)
    return out.distinct() if blocks > 1 else out


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, slack: int = 0, blocks: int | None = None) -> DataFrame:
    """Index and search at once."""
    return search(build_index(documents), documents, items, min_words, slack, blocks)
