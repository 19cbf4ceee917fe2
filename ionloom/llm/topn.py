"""The N best items of every group, by stored sorted runs and a loser-tree merge.

Rows are spread by their item, so a group that holds any share of all rows is spread too. Each task gets the
rows of an item together, keeps its latest one, sorts RUN_ROWS items at a time by (group, score, ties) and cuts
every group to its first N: a sorted run. Runs are stored by bucket of groups; a bucket is read in the order of
its groups and runs, a block of whole groups at a time, whose runs a loser tree merges: after N outputs of a
group it seeks every run to its next group. No task holds more than a run, or a block's groups with N rows
of each run.

Defined results: rows with a null group belong to no group; items whose latest row has a null, NaN,
infinite or non-positive score are out; null tie values come after all others; equal rows are one item;
a null version is older than any other; fewer than N items give what there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.runtime import stored

#: Rows from which a run is made, and from which on a block of groups is merged.
RUN_ROWS, BLOCK_ROWS = 500_000, 200_000


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Ranks of the values in byte order; null is 0."""
    d = column.combine_chunks().dictionary_encode()
    words = d.dictionary.to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.zeros(len(words) + 1, dtype=np.int64)
    rank[order] = np.arange(1, len(words) + 1)
    idx = d.indices.fill_null(len(words)).to_numpy(zero_copy_only=False)
    return rank[idx]


def make_run(t: pa.Table, n: int) -> pa.Table:
    """One sorted run: the latest row of each item, unusable scores dropped, the first ``n`` of each group."""
    grp = t["grp"].to_numpy()
    k1, k2 = _codes(t["k1"]), _codes(t["k2"])
    mz = t["tie_num"].to_numpy().astype(float)
    no_mz = t["tie_num"].is_null().to_numpy(zero_copy_only=False)
    mz = np.where(no_mz, np.inf, mz)
    version, rid = t["version"].fill_null(np.iinfo(np.int64).min).to_numpy(), t["rid"].to_numpy()
    # NaN sorts last and equals itself here, as it does in Spark.
    key = np.nan_to_num(mz, nan=np.finfo(float).max, posinf=np.inf)
    at = np.lexsort((rid, version, no_mz, key, k2, k1, grp))
    same = np.zeros(len(at), dtype=bool)
    if len(at) > 1:
        a, b = at[:-1], at[1:]
        same[:-1] = (grp[a] == grp[b]) & (k1[a] == k1[b]) & (k2[a] == k2[b]) & (key[a] == key[b]) & (no_mz[a] == no_mz[b])
    keep = at[~same]
    score = t["score"].to_numpy().astype(float)
    keep = keep[np.isfinite(score[keep]) & (score[keep] > 0)]
    label = np.where(k2 == 0, np.iinfo(np.int64).max, k2)
    keep = keep[np.lexsort((rid[keep], label[keep], key[keep], -score[keep], grp[keep]))]
    g = grp[keep]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.array([], dtype=int)
    within = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    keep = keep[within < n]
    out = t.select(["grp", "rid", "score", "tie_num", "k2"]).take(pa.array(keep))
    return out.append_column("seq", pa.array(np.arange(len(keep), dtype=np.int64)))


class LoserTree:
    """Winner of K cursors in log K comparisons; ``key`` of a leaf is replaced by the caller before ``replay``."""

    def __init__(self, keys: list):
        self.k = k = max(1, len(keys))
        self.key = keys
        self.tree = [0] * k
        winners = [0] * (2 * k)
        winners[k:] = range(k)
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (b, a) if keys[b] < keys[a] else (a, b)
        self.winner = winners[1] if k > 1 else 0

    def replay(self, leaf: int) -> None:
        """After the winning leaf's key changed."""
        key, tree = self.key, self.tree
        w, node = leaf, (leaf + self.k) >> 1
        while node:
            rival = tree[node]
            if key[rival] < key[w]:
                tree[node], w = w, rival
            node >>= 1
        self.winner = w


END = (float("inf"),)


def merge_runs(t: pa.Table, n: int) -> tuple[list[int], list[int]]:
    """Row numbers and ranks of the first ``n`` rows of every group over the runs in ``t`` (sorted by run, seq)."""
    grp = t["grp"].to_numpy()
    run = t["run"].to_numpy()
    rows = len(grp)
    if not rows:
        return [], []
    bounds = np.r_[np.flatnonzero(np.r_[True, run[1:] != run[:-1]]), rows]
    change = np.r_[(grp[1:] != grp[:-1]) | (run[1:] != run[:-1]), True]
    # For each row the first row of its run's next group.
    ends = np.flatnonzero(change) + 1
    nxt = np.repeat(ends, np.diff(np.r_[0, ends])).tolist()
    mz = t["tie_num"].fill_null(float("inf")).to_numpy()
    mz = np.nan_to_num(mz, nan=np.finfo(float).max, posinf=np.inf)
    label = _codes(t["k2"])
    label = np.where(label == 0, np.iinfo(np.int64).max, label)
    # Keys are made only where a cursor stands; the bucket itself stays in arrays.
    g, s, m, k, r = grp.item, (-t["score"].to_numpy().astype(float)).item, mz.item, label.item, t["rid"].to_numpy().item
    cursor, end = bounds[:-1].tolist(), bounds[1:].tolist()
    tree = LoserTree([(g(i), s(i), m(i), k(i), r(i)) for i in cursor])
    out, ranks, group, taken = [], [], None, 0
    key = tree.key
    while True:
        w = tree.winner
        top = key[w]
        if top is END:
            return out, ranks
        at = cursor[w]
        if top[0] != group:
            group, taken = top[0], 0
        if taken < n:
            out.append(at)
            ranks.append(taken)
            taken += 1
            at += 1
        else:
            at = nxt[at]
        cursor[w] = at
        key[w] = (g(at), s(at), m(at), k(at), r(at)) if at < end[w] else END
        tree.replay(w)


def _runs(n: int, run_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come in the order of items; a run ends with an item."""
        part, no, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def made(batches_: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = make_run(pa.Table.from_batches(batches_), n)
            yield from t.append_column("run", pa.array(np.full(len(t), (part << 32) + no, dtype=np.int64))).to_batches(max_chunksize=20_000)

        for b in batches:
            if rows >= run_rows and b.num_rows:
                end = _same_item(held[-1], b)
                if end < b.num_rows:
                    yield from made([*held, b.slice(0, end)] if end else held)
                    no, held, rows, b = no + 1, [], 0, b.slice(end)
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
        if held:
            yield from made(held)

    return run


def _same_item(before: pa.RecordBatch, b: pa.RecordBatch) -> int:
    """How many rows of ``b`` belong to the last item of ``before``."""
    cols = [b.schema.get_field_index(c) for c in ("grp", "k1", "k2", "tie_num")]
    last = [before.column(c)[before.num_rows - 1].as_py() for c in cols]
    same = lambda x, y: x == y or (x != x and y != y)
    n = 0
    while n < b.num_rows and all(same(b.column(c)[n].as_py(), v) for c, v in zip(cols, last)):
        n += 1
    return n


def _merged(n: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come in the order of groups; a block ends with a group."""
        held, rows = [], 0

        def made() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            t = t.take(pa.array(np.lexsort((t["seq"].to_numpy(), t["run"].to_numpy()))))
            at, ranks = merge_runs(t, n)
            out = t.select(["grp", "rid", "score", "tie_num", "k2"]).take(pa.array(at)).append_column("rank", pa.array(ranks, pa.int32()))
            yield from out.to_batches(max_chunksize=20_000)

        for b in batches:
            if not b.num_rows:
                continue
            if rows >= block_rows:
                g = b.column(0).to_numpy()
                end = int(np.searchsorted(g, held[-1].column(0)[held[-1].num_rows - 1].as_py(), side="right"))
                if end < b.num_rows:
                    held.append(b.slice(0, end))
                    yield from made()
                    held, rows, b = [], 0, b.slice(end)
            held.append(b)
            rows += b.num_rows
        if held:
            yield from made()

    return run


def top_items(rows: DataFrame, n: int = 8, group: str = "eg_id", row_id: str = "ion_row_id", item: tuple[str, str] = ("run_id", "fragment_label"), tie_number: str = "fragment_mz", score: str = "fragment_intensity", version: str = "loaded_at", run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(grp, rid, score, tie_num, k2, rank from 0): the ``n`` best items of each group by score descending,
    then ``tie_number``, the second item column and the row id ascending. An item is a group with equal
    item columns and ``tie_number``; its latest row by ``version``, then row id, counts."""
    d = rows.select(
        F.col(group).cast("long").alias("grp"), F.col(item[0]).cast("string").alias("k1"), F.col(item[1]).cast("string").alias("k2"), F.col(tie_number).cast("double").alias("tie_num"),
        F.col(score).cast("double").alias("score"), F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(version).cast("timestamp_ntz")).alias("version"), F.col(row_id).cast("long").alias("rid"),
    ).filter("grp is not null and rid is not null")
    # As many parts as the session says; what a task holds doesn't depend on them.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_item = d.repartition(parts, "grp", "k1", "k2", "tie_num").sortWithinPartitions("grp", "k1", "k2", "tie_num")
    runs = by_item.mapInArrow(_runs(n, run_rows), "grp long, rid long, score double, tie_num double, k2 string, seq long, run long")
    buckets = stored(runs).repartition(parts, "grp").sortWithinPartitions("grp", "run", "seq")
    return buckets.mapInArrow(_merged(n, block_rows), "grp long, rid long, score double, tie_num double, k2 string, rank int")
