"""Mixtures of sources with target shares of the total size in tokens.

Sizes are counted once with a public tokenizer. Capped water-filling gives each source its number of
repetitions: sources that would be repeated beyond their cap are clamped to it and the rest of the weight
goes to the others in proportion, until no source is beyond its cap. The whole part of a repetition takes
every document; the fraction takes the documents whose seeded hash lies below a threshold, found in a
histogram of tokens over the hash.

Without a given total, the largest total is taken at which every source that has documents reaches its
share, so the reached shares are the targets (rescaled over the sources that have documents). One tiny source
then bounds the whole mix, as the report shows: its column ``bounds_mix`` names the source at its cap, and
``unused_share`` says how much of a source's repeatable tokens stay out for it. With ``total="once"`` the total
is the tokens of all the mix's sources, each once: sources that can't reach their share within their cap are
clamped to it, the others take over their weight, and the report shows by how much shares differ.

Defined results: source names are compared in lower case, trimmed, blanks and hyphens as underscores; null
sources are in no mix; empty and null texts have no tokens and are not selected; a repeated doc_id is one
document, its largest text counts; a source without documents reaches 0 and its share goes to the rest; of
repeated targets of one source in a mix the shares add up and the smallest cap counts; null shares are 0,
null caps 1.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.runtime import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that cuts text into pieces before byte pairs are merged.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Slots of the seeded hash in which a source's tokens are counted.
SLOTS = 4096
SEED = 17


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("mixing", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, id_col: str, text_col: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, *keep, n_tokens): whole texts through the tokenizer, in Arrow batches."""
    kept = texts.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_il_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return kept.mapInArrow(run, schema)


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def water_fill(tokens: dict[str, int], shares: dict[str, float], caps: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Repetitions per source. ``total`` None: the largest total at which no source is clamped."""
    have = {s: w for s, w in shares.items() if tokens.get(s, 0) > 0 and w > 0 and caps[s] > 0}
    if not have:
        return {s: 0.0 for s in shares}
    if total is None:
        weight = sum(have.values())
        total = min(caps[s] * tokens[s] * weight / w for s, w in have.items())
    reps, free, left = {s: 0.0 for s in shares}, dict(have), float(total)
    while free:
        weight = sum(free.values())
        over = [s for s, w in free.items() if left * w / weight > caps[s] * tokens[s] * (1 + 1e-12)]
        if not over:
            for s, w in free.items():
                reps[s] = min(float(caps[s]), left * w / weight / tokens[s])
            break
        for s in over:
            reps[s] = float(caps[s])
            left -= caps[s] * tokens[s]
            del free[s]
    return reps


def _plan(targets: list, tokens: dict[tuple[str, str], dict[int, int]], total: float | str | None) -> list[tuple]:
    """(mix, source, share, cap, repetitions, whole, last slot of the fraction, tokens, those of the largest slot,
    clamped, bounds the mix) per target."""
    mixes: dict[str, dict[str, list]] = {}
    for mix, source, share, cap in targets:
        e = mixes.setdefault(mix, {}).setdefault(source, [0.0, None])
        e[0] += share or 0.0
        c = 1 if cap is None else max(0, cap)
        e[1] = c if e[1] is None else min(e[1], c)
    out = []
    for mix, by in sorted(mixes.items()):
        sizes = {s: sum(tokens.get((mix, s), {}).values()) for s in by}
        reps = water_fill(sizes, {s: e[0] for s, e in by.items()}, {s: e[1] for s, e in by.items()}, float(sum(sizes.values())) if total == "once" else total)
        for s, (share, cap) in sorted(by.items()):
            whole = int(reps[s] + 1e-9)
            want, got, last = (reps[s] - whole) * sizes[s], 0.0, -1
            for slot in range(SLOTS):
                n = tokens.get((mix, s), {}).get(slot, 0)
                if want - got <= n / 2:
                    break
                got, last = got + n, slot
            at_cap = sizes[s] > 0 and share > 0 and reps[s] >= cap * (1 - 1e-9)
            largest = max(tokens.get((mix, s), {}).values(), default=0)
            out.append((mix, s, share, cap, reps[s], whole, last if whole < cap else -1, sizes[s], largest, at_cap and total is not None, at_cap and total is None))
    return out


PLAN = "mix_name string, source string, target_share double, max_repeats int, repetitions double, whole int, last_slot int, source_tokens long, largest_slot long, clamped boolean, bounds_mix boolean"


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total: float | str | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(selection, plan). Selection: (mix_name, source, doc_id, copies, n_tokens), one row per chosen document.

    What reaches the driver is the targets and one histogram of SLOTS counts per target."""
    spark = documents.sparkSession
    wanted = targets.select("mix_name", source_name(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).filter("mix_name is not null and source is not null")
    rows = [tuple(r) for r in wanted.collect()]
    mixes = spark.createDataFrame(sorted({(m, s) for m, s, _, _ in rows}), "mix_name string, source string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), F.col("text")).filter("doc_id is not null")
    docs = docs.join(F.broadcast(mixes.select("source").distinct()), "source", "left_semi")
    counted = token_counts(docs, "doc_id", "text", ["source"], tokenizer).filter("n_tokens > 0")
    counted = stored(counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("m")).select("doc_id", "m.source", "m.n_tokens"))
    slot = F.pmod(F.xxhash64("doc_id", "mix_name", F.lit(seed)), F.lit(SLOTS)).cast("int")
    placed = counted.join(F.broadcast(mixes), "source").withColumn("slot", slot)
    tokens: dict[tuple[str, str], dict[int, int]] = {}
    for m, s, k, n in placed.groupBy("mix_name", "source", "slot").agg(F.sum("n_tokens")).collect():
        tokens.setdefault((m, s), {})[k] = n
    plan = spark.createDataFrame(_plan(rows, tokens, total), PLAN)
    chosen = placed.join(F.broadcast(plan), ["mix_name", "source"]).withColumn("copies", F.col("whole") + F.when(F.col("slot") <= F.col("last_slot"), 1).otherwise(0))
    return chosen.filter("copies > 0").select("mix_name", "source", "doc_id", "copies", "n_tokens"), plan


def shares(selection: DataFrame, plan: DataFrame) -> DataFrame:
    """The report: target and reached share, tokens, most repetitions and whether it is at its cap, per source of each mix."""
    got = selection.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("n_docs"))
    total = got.groupBy("mix_name").agg(F.sum("n_tokens").alias("mix_tokens"))
    out = plan.join(got, ["mix_name", "source"], "left").join(total, "mix_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    used = F.when(F.col("source_tokens") * F.col("max_repeats") > 0, 1 - F.coalesce(F.col("n_tokens"), F.lit(0)) / (F.col("source_tokens") * F.col("max_repeats")))
    return out.select("mix_name", "source", "target_share", F.coalesce(F.col("n_tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("reached_share"), "max_repeats", "repetitions", zero("most_copies"), zero("n_docs"), zero("n_tokens"), "source_tokens", "largest_slot", "clamped", "bounds_mix", used.alias("unused_share"))
