"""Subject areas of documents, from a classifier of sentences.

The model is an averaged embedding of a sentence's words and subwords with an independent logistic output
per subject. It is trained on the sentences of labelled documents, each with its document's share of votes
per subject: every step sums the gradients over all partitions and moves the shared weights once, so the model
doesn't depend on how the sentences are spread. The number of steps is the same whatever the data. Every
document is scored: a sentence has the subject of its highest output if that is likely enough, and a document
has the subjects of at least a fourth of its sentences. Its sentences are read once and kept as numbers.

Sentences that do not count for a subject: text quoted from the held-out test items (they share runs of
words with an item, numbers aside) and page footers (sentences which, numbers aside, all over the corpus
stand only at the end of documents, and of at least FOOTER). They still are sentences of the document.

Bounds: at most ``MAX_LABELLED`` labelled documents train the model, those with the smallest seeded hash;
the shared weights have a fixed size, whatever the data; the held-out items must fit a broadcast.

Defined results: null and empty texts, texts without words and texts on no subject give no row; labels
with a null subject or document, or with a subject that is not in the list, do not count; repeated labels
of one annotator count once; without any label there is no model and no row.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.runtime import BROADCAST_BYTES, fits_broadcast, release, sized_join, stored

MAX_LABELLED = 20_000
SLOTS, DIM = 1 << 15, 16
STEPS, RATE = 40, 0.15
#: Sentences in a row of training arrays.
CHUNK = 20_000
#: Tasks whose gradients the driver adds itself; beyond, they are first added by pieces of the weights.
SUMMING, PIECES = 8, 16
#: Documents that a page footer ends at least.
FOOTER = 5
SEED = 11
SHARE, LIKELY = 0.25, 0.35
QUOTE_RUN = 5

LETTERS = re.compile(r"[^\W\d_]+")
TOKENS = re.compile(r"[^\W\d_]+|\d+")
DIGITS = re.compile(r"\d+")
LINE_START = re.compile(r"^(?:\s|[>|*#•-](?=\s|[>|*#•-])|\d{1,2}:\d\d(?=\s)|\w{1,20}:(?=\s)|\[\w+\](?=\s))+")
SENTENCE_END = re.compile(r"(?<=[.?!])[\"'»”)]*\s+")
ENDS = re.compile(r"[.?!][\"'»”)]*\s*$")


def sentences(text: str) -> list[str]:
    """The sentences of a text: what ends like one, without titles, list marks, speakers and code."""
    out, code = [], False
    for line in text.split("\n"):
        if line.startswith("```"):
            code = not code
            continue
        if code:
            continue
        line = LINE_START.sub("", line)
        for s in SENTENCE_END.split(line):
            if ENDS.search(s) and LETTERS.search(s):
                out.append(s)
    return out


def shape(sentence: str) -> tuple[str, ...]:
    """Its words in folded case, numbers as ``0``."""
    return tuple(TOKENS.findall(DIGITS.sub("0", sentence.casefold())))


def features(word: str) -> list[int]:
    """Slots of a word and its subwords of 4 and 5 characters."""
    w = f"<{word}>"
    parts = [w] + [w[i : i + n] for n in (4, 5) for i in range(len(w) - n + 1) if len(w) > n]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & (SLOTS - 1) for p in parts]


def initial(n_subjects: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.uniform(-1, 1, (SLOTS, DIM)) / DIM).astype(np.float32), np.zeros((DIM, n_subjects), np.float32), np.full(n_subjects, -2.0, np.float32)


def packed_examples(words: list[list[str]], votes: list[list[float]]) -> dict[str, np.ndarray]:
    """Sentences as arrays: words by number, and the slots of each word seen."""
    at: dict[str, int] = {}
    slots: list[int] = []
    starts: list[int] = []
    flat: list[int] = []
    for ws in words:
        for x in ws:
            k = at.get(x)
            if k is None:
                k = at[x] = len(starts)
                starts.append(len(slots))
                slots.extend(features(x))
            flat.append(k)
    flat_, slots_, lens = np.array(flat, np.int32), np.array(slots, np.int32), np.array([len(w) for w in words], np.int32)
    per = np.diff(np.r_[starts, len(slots)])
    by_word = np.argsort(flat_, kind="stable")
    by_slot = np.argsort(slots_, kind="stable")
    used, slot_heads = np.unique(slots_[by_slot], return_index=True)
    return {
        "flat": flat_, "lens": lens, "slots": slots_, "starts": np.array(starts, np.int32), "used": used.astype(np.int32), "slot_heads": slot_heads.astype(np.int32), "y": np.array(votes, np.float32).ravel(),
        # Where each word and each slot stands, in their order, so that gradients are sums of neighbours.
        "sentence_of": np.repeat(np.arange(len(lens)), lens)[by_word].astype(np.int32), "word_heads": np.searchsorted(flat_[by_word], np.arange(len(starts))).astype(np.int32), "word_of": np.repeat(np.arange(len(starts)), per)[by_slot].astype(np.int32),
    }


def gradient(weights, x: dict[str, np.ndarray], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slots used, gradient of their embeddings, of the outputs, of the biases), summed over the sentences."""
    e, w, b = weights
    flat, lens, slots, starts, y = x["flat"], x["lens"], x["slots"], x["starts"], x["y"].reshape(len(x["lens"]), -1)
    per = np.diff(np.r_[starts, len(slots)]).astype(np.float32)[:, None]
    vec = np.add.reduceat(e[slots], starts, axis=0) / per
    n = lens.astype(np.float32)[:, None]
    mean = np.add.reduceat(vec[flat], np.r_[0, np.cumsum(lens)[:-1]], axis=0) / n
    err = (1 / (1 + np.exp(-(mean @ w + b))) - y) * times[:, None]
    d_word = np.add.reduceat(((err @ w.T) / n)[x["sentence_of"]], x["word_heads"], axis=0) / per
    d_e = np.add.reduceat(d_word[x["word_of"]], x["slot_heads"], axis=0)
    return x["used"], d_e, mean.T @ err, err.sum(axis=0)


class Scorer:
    """Subjects of many sentences at once; each word's part is kept."""

    def __init__(self, weights):
        e, w, self.b = weights
        self.ew = e @ w
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, w.shape[1]), np.float32)

    def _learn(self, words: set[str]) -> None:
        for x in words:
            k = self.at[x] = len(self.at)
            if k >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[k] = self.ew[features(x)].mean(axis=0)

    def subjects(self, sentences_: list[list[str]]) -> list[int]:
        """The number of the likeliest subject of each sentence (a list of words), or -1."""
        if not sentences_:
            return []
        if len(self.at) > 200_000:
            self.at.clear()
        self._learn({x for ws in sentences_ for x in ws} - self.at.keys())
        at = self.at
        flat = np.array([at[x] for ws in sentences_ for x in ws])
        lens = np.array([len(ws) for ws in sentences_])
        logits = np.add.reduceat(self.rows[flat], np.r_[0, np.cumsum(lens)[:-1]], axis=0) / lens[:, None] + self.b
        k = logits.argmax(axis=1)
        return np.where(logits[np.arange(len(k)), k] > math.log(LIKELY / (1 - LIKELY)), k, -1).tolist()


def quotes(key: tuple[str, ...], quoted: frozenset) -> bool:
    """Whether a sentence shares runs of words with the held-out items."""
    return sum(map(quoted.__contains__, zip(*(key[i:] for i in range(QUOTE_RUN))))) >= 2


def shape_hash(key: tuple[str, ...]) -> int:
    """64 bits that stand for a shape."""
    return int.from_bytes(hashlib.blake2b(" ".join(key).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def read_documents(texts: list[str], scorer, quoted: frozenset, memo: dict) -> Iterator[tuple[list[int], list[int]]]:
    """(hash of its shape, subject or -1) of every sentence of each text. ``memo`` keeps sentences already seen."""
    if len(memo) > 100_000:
        memo.clear()
    found = [[DIGITS.sub("0", s) for s in sentences(t)] for t in texts]
    new = {s for many in found for s in many if s not in memo}
    wanted, words = [], []
    for s in new:
        key = tuple(TOKENS.findall(s.casefold()))  # its digits are 0 already
        ws = [x for x in key if x != "0"]
        if ws and not quotes(key, quoted):
            wanted.append((s, key))
            words.append(ws)
        else:
            memo[s] = shape_hash(key), -1
    for (s, key), k in zip(wanted, scorer.subjects(words)):
        memo[s] = shape_hash(key), k
    for many in found:
        got = [memo[s] for s in many]
        yield [h for h, _ in got], [k for _, k in got]


def quoted_runs(items: DataFrame | None) -> frozenset:
    """Runs of words of the held-out items (measured first, as every task gets them), numbers as ``0``."""
    if items is None:
        return frozenset()
    if not fits_broadcast(items.select(F.col("text").cast("string").alias("text"))):
        raise ValueError(f"held-out items of more than {BROADCAST_BYTES} bytes")
    out = set()
    for r in items.select(F.col("text").cast("string").alias("text")).filter("text is not null").toLocalIterator():
        key = shape(r.text)
        out.update(key[j : j + QUOTE_RUN] for j in range(len(key) - QUOTE_RUN + 1))
    return frozenset(out)


def training_sentences(documents: DataFrame, labels: DataFrame, names: list[str], quoted: frozenset, limit: int = MAX_LABELLED) -> DataFrame:
    """The labelled documents' sentences as rows of arrays, CHUNK sentences each at most."""
    votes = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "subject", "annotator").filter(F.col("doc_id").isNotNull() & F.col("subject").isin(names)).distinct()
    per = votes.groupBy("doc_id").agg(F.countDistinct(F.coalesce("annotator", F.lit(""))).alias("n"), F.collect_list("subject").alias("subjects"))
    per = per.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(limit)
    docs = sized_join(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null"), per, ["doc_id"], "inner").select("text", "n", "subjects")
    number = {s: i for i, s in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = [], []
            for text, n, subjects in zip(*(c.to_pylist() for c in b.columns)):
                y = [0.0] * len(names)
                for s in subjects:
                    y[number[s]] += 1.0 / n
                y = [min(1.0, v) for v in y]
                for s in sentences(text):
                    key = shape(s)
                    words = [x for x in key if x != "0"]
                    if words and not quotes(key, quoted):
                        xs.append(" ".join(words))
                        ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.string()), pa.array(ys, pa.list_(pa.float32()))], names=["words", "y"])

    # Equal sentences are one with their mean votes and their number.
    each = docs.mapInArrow(run, "words string, y array<float>").groupBy("words").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("y")[i]).alias(f"y{i}") for i in range(len(names))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                c = b.slice(i, CHUNK)
                n = c.column(1).to_numpy()
                x = packed_examples([t.split(" ") for t in c.column(0).to_pylist()], [])
                x["y"] = (np.stack([c.column(2 + k).to_numpy() for k in range(len(names))], axis=1) / n[:, None]).astype(np.float32).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([x[k].tobytes()], pa.binary()) for k in EXAMPLE] + [pa.array([n.astype(np.float32).tobytes()], pa.binary()), pa.array([len(n)], pa.int64())], names=[*EXAMPLE, "times", "n"])

    return stored(each.mapInArrow(pack, ", ".join(f"{k} binary" for k in EXAMPLE) + ", times binary, n long"))


EXAMPLE = {**dict.fromkeys(("flat", "lens", "slots", "starts", "used", "slot_heads", "sentence_of", "word_heads", "word_of"), np.int32), "y": np.float32}


def train(examples: DataFrame, n_subjects: int, steps: int = STEPS):
    """Weights after ``steps`` synchronised steps; None without examples.

    Every step sums the gradients of all sentences over all partitions, pre-aggregated in each task and then by
    pieces of the weights; what reaches the driver is the sum, of the weights' own size."""
    if not examples._il_rows:
        return None
    e, w, b = initial(n_subjects)
    # Only slots of words that were seen are sent around; the rest stay as they are.
    chunks = examples.select("n", "used").collect()  # one row per CHUNK sentences of the labelled documents, whose number is bounded
    total = float(sum(r.n for r in chunks))
    seen = np.unique(np.concatenate([np.frombuffer(r.used, np.int32) for r in chunks]))
    weights = e[seen], w, b
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in weights]
    tail = DIM * n_subjects + n_subjects
    few = examples.rdd.getNumPartitions() <= SUMMING

    sc = examples.sparkSession.sparkContext
    for t in range(1, steps + 1):
        shared = sc.broadcast((seen, *weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seen_, *now = shared.value
            d_e, d_w, d_b = (np.zeros_like(x) for x in now)
            for b in batches:
                for row in b.to_pylist():
                    x = {k: np.frombuffer(row[k], kind) for k, kind in EXAMPLE.items()}
                    for k in ("slots", "used"):
                        x[k] = np.searchsorted(seen_, x[k])
                    used, g_e, g_w, g_b = gradient(now, x, np.frombuffer(row["times"], np.float32))
                    d_e[used] += g_e
                    d_w += g_w
                    d_b += g_b
            parts = [*np.array_split(d_e, PIECES), np.r_[d_w.ravel(), d_b]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["piece", "g"])

        def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in frames:
                for piece, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    v = np.frombuffer(g, np.float32)
                    sums[piece] = sums[piece] + v if piece in sums else v
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())], names=["piece", "g"])

        sums = examples.mapInArrow(run, "piece int, g binary")
        got: dict[int, np.ndarray] = {}
        for r in (sums if few else sums.repartition(SUMMING, "piece").mapInArrow(add, "piece int, g binary")).collect():
            v = np.frombuffer(r.g, np.float32)
            got[r.piece] = got[r.piece] + v if r.piece in got else v
        rest = got[PIECES]
        grads = np.concatenate([got[i] for i in range(PIECES)]).reshape(len(seen), DIM) / total, rest[: tail - n_subjects].reshape(DIM, n_subjects) / total, rest[tail - n_subjects :] / total
        weights = tuple(_step(x, g, m, t) for x, g, m in zip(weights, grads, moments))
        shared.destroy()
    e[seen] = weights[0]
    return e, *weights[1:]


def _step(x: np.ndarray, g: np.ndarray, moments: tuple[np.ndarray, np.ndarray], t: int) -> np.ndarray:
    """A step with running means of the gradient and of its square."""
    m, v = moments
    m += (1 - 0.9) * (g - m)
    v += (1 - 0.99) * (g * g - v)
    return (x - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def read_all(documents: DataFrame, weights, quoted: frozenset) -> DataFrame:
    """(doc_id, hashes, found): every document's sentences once, by shape and subject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, memo = Scorer(weights), {}
        for b in batches:
            # A thousand texts at once, however long the batch.
            for i in range(0, b.num_rows, 1000):
                c = b.slice(i, 1000)
                rows = list(read_documents(c.column(1).to_pylist(), scorer, quoted, memo))
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int8()))], names=["doc_id", "hashes", "found"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    return docs.mapInArrow(run, "doc_id long, hashes array<long>, found array<byte>").filter("size(hashes) > 0")


def page_footers(read: DataFrame) -> DataFrame:
    """(last): shapes that end at least FOOTER documents and stand at most a ninth as often anywhere else."""
    ends = read.groupBy(F.element_at("hashes", -1).alias("last")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FOOTER)
    ends = stored(ends)
    others = read.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("last"))
    inside = sized_join(others, ends, ["last"], "inner").groupBy("last").agg(F.count(F.lit(1)).alias("elsewhere"))
    return ends.join(inside, "last", "left").filter(F.coalesce("elsewhere", F.lit(0)) * 9 <= F.col("n")).select("last")


def subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject) of every document that deals with a subject. ``areas`` has a fixed few rows."""
    spark = documents.sparkSession
    names = sorted(r[0] for r in areas.select("subject").filter("subject is not null").distinct().collect())
    quoted = quoted_runs(items)
    examples = training_sentences(documents, labels, names, quoted) if names else None
    weights = train(examples, len(names)) if names else None
    if examples is not None:
        release(spark, examples)
    if weights is None:
        return spark.createDataFrame([], "doc_id long, subject string")
    read = stored(read_all(documents, weights, quoted))
    footers = stored(page_footers(read)).withColumn("footer", F.lit(True))
    judged = sized_join(read.withColumn("last", F.element_at("hashes", -1)), footers, ["last"])
    counted = judged.withColumn("_own", F.when(F.col("footer"), F.slice("found", 1, F.size("found") - 1)).otherwise(F.col("found")))
    number = F.array(*[F.lit(n) for n in names])
    per = counted.select("doc_id", F.size("found").alias("n"), F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.struct(k.alias("k"), F.size(F.filter("_own", lambda x: x == k)).alias("m"))), lambda s: s.m > 0).alias("s"))
    return per.select("doc_id", "n", F.explode("s").alias("s")).filter(F.col("s.m") >= SHARE * F.col("n")).filter("doc_id is not null").select("doc_id", F.element_at(number, F.col("s.k") + 1).alias("subject")).distinct()
