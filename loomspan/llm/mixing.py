"""Mixing sources to target weights by weighted pivotal rounding.

A source's documents all want the same number of copies, its quota; the whole part is given to each, the
fraction is rounded by the pivotal method: two documents with fractional probabilities trade token mass until
one of them is whole, with odds that keep every expectation. The tokens chosen never change but for the last
document of a source. Each partition rounds its own documents and keeps one residual a source; residuals are
combined in a tree of fan-in ``FAN_IN`` until one a source is left, which is drawn.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import cut

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Blocks whose residuals one task combines, documents of a block and sources of a bucket (about).
FAN_IN, BLOCK_ROWS, BUCKET_SOURCES = 64, 50_000, 1_000
#: Targets that may travel to every task; more are joined by a shuffle, hot sources split by the adaptive plan.
BROADCAST_TARGETS = 100_000


@lru_cache(maxsize=2)
def _encoder(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    """Sources are compared trimmed, lower-cased and with _ read as -; blank ones are null."""
    key = F.translate(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), "_", "-")
    return F.when(key != "", key)


def count_tokens(df: DataFrame, text: str, *keep: str, vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the tokens of the whole text; 0 for null and empty ones."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary).encode_ordinary
        for batch in batches:
            tokens = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(tokens, pa.int64())], [*keep, "tokens"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def _pivot(ids: np.ndarray, mass: np.ndarray, prob: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds all but one probability; returns them and the place of the one left, -1 if none is.

    Tokens sum(mass * prob) stay as they are, and so does the expectation of each probability.
    """
    prob, open_ = prob.copy(), -1
    for i in range(len(ids)):
        if mass[i] == 0 or not 0 < prob[i] < 1:
            prob[i] = float(prob[i] >= 1 or (0 < prob[i] and draws[i] < prob[i]))
            continue
        if open_ < 0:
            open_ = i
            continue
        a, b = open_, i
        up = min((1 - prob[a]) * mass[a], prob[b] * mass[b])  # from b to a
        down = min(prob[a] * mass[a], (1 - prob[b]) * mass[b])  # from a to b
        moved = up if draws[i] * (up + down) < down else -down
        pa_, pb_ = prob[a] + moved / mass[a], prob[b] - moved / mass[b]
        prob[a], prob[b] = (round(p) if abs(p - round(p)) < 1e-9 else p for p in (pa_, pb_))
        open_ = a if 0 < prob[a] < 1 else b if 0 < prob[b] < 1 else -1
    return prob, open_


def _round_group(t: pd.DataFrame) -> pd.DataFrame:
    """One row in, one out: ``extra`` is 0 or 1, or null for the residual with its probability."""
    out = []
    for _, g in t.sort_values(["source", "key", "occurrence", "draw"], kind="stable").groupby("source", sort=True):
        prob, left = _pivot(g["key"].to_numpy(), g["tokens"].to_numpy(np.float64), g["prob"].to_numpy(np.float64), g["draw"].to_numpy(np.float64))
        extra = prob.astype(object)
        if left >= 0:
            extra[left] = None
        out.append(g.assign(prob=prob, extra=pd.array([None if x is None else int(x) for x in extra], dtype="Int32")))
    return pd.concat(out) if out else t.assign(extra=pd.array([], dtype="Int32"))


_ROUNDED = "key long, occurrence long, source string, tokens long, whole int, prob double, block long, bucket int, draw double, extra int"


def plan_shares(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: its tokens, capacity, quota of copies and whether the target can be reached."""
    per = tokens.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    total = per.where(F.col("source").isNotNull()).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("corpus_tokens"))
    wanted = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    shares = wanted.join(per, "source", "left").fillna(0, ["tokens", "documents"]).crossJoin(F.broadcast(total))
    goal = F.col("target_share") * F.col("corpus_tokens")
    return shares.select(
        "*",
        (F.col("tokens") * F.col("max_repeats")).alias("capacity"),
        (F.col("tokens") * F.col("max_repeats") >= goal).alias("reachable"),
        F.when((F.col("tokens") > 0) & (F.col("target_share") > 0), F.least(F.col("max_repeats").cast("double"), goal / F.col("tokens"))).otherwise(0.0).alias("quota"),
    )


def mix(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: copies of each document, and the shares reached.

    Copies: ``key, source, tokens, copies`` for every document of a target source; documents of other or
    blank sources are left out. Report, one row a target: ``target_share, max_repeats, documents, tokens,
    capacity, corpus_tokens, reachable, quota, mixed_tokens, mixed_share`` (of the mix as it came out) and
    ``planned_share`` (of a mix as large as the corpus, against which targets are set), and ``short``: the mix
    holds fewer tokens of the source than its target asks for, though each of its documents is repeated
    max_repeats times. Texts that are null or empty weigh nothing; repeated rows count each; an empty table
    gives shares of null. Draws come from hashes of the key and its occurrence, so neither a lost task nor
    another file layout changes them.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), source_key(F.col(source)).alias("source"), F.col(text).alias("text")).where(F.col("source").isNotNull())
    counted = count_tokens(rows, "text", "key", "source", vocabulary=vocabulary).groupBy("key", "source", "tokens").agg(F.count("*").alias("n"))
    tokens = cut(counted.select("key", "source", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("occurrence")))
    shares = cut(plan_shares(tokens, targets))
    n_targets = shares.count()
    quota = shares.select("source", "quota")
    if n_targets <= BROADCAST_TARGETS:
        quota = F.broadcast(quota)
    blocks = 1 << max(0, math.ceil(math.log2(max(1, tokens.count()) / BLOCK_ROWS)))
    draw = lambda salt: (F.pmod(F.xxhash64("key", "occurrence", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    bucket = F.pmod(F.hash("source"), F.lit(math.ceil(max(1, n_targets) / BUCKET_SOURCES)))
    wants = tokens.join(quota, "source").select(
        "key", "occurrence", "source", "tokens", F.floor("quota").cast("int").alias("whole"), (F.col("quota") - F.floor("quota")).alias("prob"),
        F.pmod(F.xxhash64("key", "occurrence", F.lit(seed)), F.lit(blocks)).alias("block"), bucket.alias("bucket"), draw(0).alias("draw"),
    )
    rounded = cut(wants.groupBy("block").applyInPandas(lambda t: _round_group(t), _ROUNDED))
    finished = rounded.where(F.col("extra").isNotNull())
    rest = rounded.where(F.col("extra").isNull()).drop("extra")
    level = 0
    while blocks > 1:  # the tree: residuals of FAN_IN blocks meet in a task, some sources at a time
        level += 1
        blocks = math.ceil(blocks / FAN_IN)
        met = rest.withColumn("block", F.floor(F.col("block") / FAN_IN)).withColumn("draw", draw(level))
        step = cut(met.groupBy("block", "bucket").applyInPandas(lambda t: _round_group(t), _ROUNDED))
        finished = finished.unionByName(step.where(F.col("extra").isNotNull()))
        rest = step.where(F.col("extra").isNull()).drop("extra")
    drawn = rest.withColumn("extra", (draw(-1) < F.col("prob")).cast("int"))
    copies = finished.unionByName(drawn).select("key", "source", "tokens", (F.col("whole") + F.col("extra")).alias("copies"))
    mixed = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    report = shares.join(mixed, "source", "left").fillna(0, ["mixed_tokens"])
    all_ = mixed.agg(F.sum("mixed_tokens").alias("_all"))
    report = report.crossJoin(F.broadcast(all_)).withColumn("mixed_share", F.col("mixed_tokens") / F.nullif(F.col("_all"), F.lit(0))).drop("_all")
    report = report.withColumn("planned_share", F.col("mixed_tokens") / F.nullif(F.col("corpus_tokens"), F.lit(0)))
    spare = copies.join(F.broadcast(shares.select("source", "max_repeats")) if n_targets <= BROADCAST_TARGETS else shares.select("source", "max_repeats"), "source").where((F.col("tokens") > 0) & (F.col("copies") < F.col("max_repeats"))).select("source", F.lit(True).alias("_spare")).distinct()
    report = report.join(spare, "source", "left").withColumn("short", F.col("_spare").isNull() & (F.col("mixed_tokens") < F.col("target_share") * F.col("corpus_tokens"))).drop("_spare")
    return copies.withColumnRenamed("key", key), report
