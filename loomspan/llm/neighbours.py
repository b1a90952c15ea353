"""The most similar vectors for every vector, by additive quantisation.

A vector is the sum of one codeword of each of several full-dimensional codebooks. The first book (one
codeword a cell, about the square root of the rows; above ``COARSE_CELLS`` sums of two codewords) places vectors;
the others code the residual by beam
search. Vectors meet others of their own cell and of the next cells (``probes``) only, by default more of them
the more cells there are. There the queries'
lookup tables score all codes of a block, corrected by the stored norms, and the best are reranked by the
exact cosine. Books are fitted on a bounded sample; every row is coded and indexed.

Equal vectors are collapsed first, so a hot vector is one row a batch; cells and query groups above a block's
size are split over several tasks, which together still compare everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
import xxhash

from loomspan.llm.sampling import drawn
from loomspan.session import cut, shuffle_width

#: Rows the books are fitted on (about; drawn by hash, twice as many at most).
SAMPLE_ROWS = 32_768
#: Codewords of the first book that the sample can tell apart; beyond, a second book of cells is added to each of them.
COARSE_CELLS = 2_048
#: Rows one task compares, about (330 bytes each).
TASK_ROWS = 150_000
#: Residual books, codewords in each, partial codes kept in the beam search.
BOOKS, WORDS, BEAM = 4, 256, 4
#: Candidates of each query in a block that are reranked exactly, for each neighbour wanted; weakly similar ones need many.
RERANK = 12
#: Index rows and query rows that one task compares.
BLOCK_ROWS, QUERY_ROWS = 4_096, 16_384


def unit_rows(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors (not null, of this width, finite, not all zero) and their unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(lengths == width)
    if not len(fits):
        return fits, np.zeros((0, width), np.float32)
    values = column.take(pa.array(fits)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(all="ignore"):
        scale = np.abs(values).max(1, keepdims=True)
        good = np.isfinite(scale[:, 0]) & (scale[:, 0] > 0)
        values = values[good] / scale[good]
        values /= np.linalg.norm(values, axis=1, keepdims=True)
    return fits[good], values.astype(np.float32)


def _nearest(x: np.ndarray, words: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest codewords of each row, nearest first."""
    cost = (words * words).sum(1) - 2 * x @ words.T
    k = min(k, len(words))
    if k == 1:
        return cost.argmin(1)[:, None]
    part = np.argpartition(cost, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(cost, part, 1), axis=1, kind="stable"), 1)


def _means(x: np.ndarray, k: int, rnd: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Codewords by Lloyd's rounds; empty ones move to the rows that fit worst."""
    words = x[rnd.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, words)[:, 0]
        counts = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words).astype(np.float32)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            worst = np.argsort(-((x - words[near]) ** 2).sum(1))[: len(empty)]
            words[empty[: len(worst)]] = x[worst]
    return words


class Books:
    """Codebooks: ``cells`` and the residual books."""

    def __init__(self, sample: np.ndarray, cells: int, books: int = BOOKS, words: int = WORDS, seed: int = 5, coarse: int = COARSE_CELLS):
        rnd = np.random.default_rng(seed)
        self.cells = _means(sample, max(1, min(cells, coarse, len(sample) // 8)), rnd)
        finer = -(-cells // len(self.cells))
        if finer > 1 and len(sample) > 8:
            added = _means(sample - self.cells[_nearest(sample, self.cells)[:, 0]], min(finer, max(1, len(sample) // 8)), rnd)
            self.cells = (self.cells[:, None, :] + added[None, :, :]).reshape(-1, sample.shape[1])
        rest = sample - self.cells[_nearest(sample, self.cells)[:, 0]]
        left, self.books, codes = rest.copy(), [], []
        for _ in range(books):
            book = _means(left, words, rnd, 6)
            code = _nearest(left, book)[:, 0]
            left = left - book[code]
            self.books.append(book)
            codes.append(code)
        self._joint(rest, codes)

    def _joint(self, rest: np.ndarray, codes: list[np.ndarray]) -> None:
        """All books at once by least squares for the codes given: this is what makes them additive."""
        starts = np.cumsum([0, *(len(b) for b in self.books)])
        total, width = starts[-1], rest.shape[1]
        gram, right = np.zeros((total, total)), np.zeros((total, width))
        for i, a in enumerate(codes):
            np.add.at(right, starts[i] + a, rest)
            for j, b in enumerate(codes):
                gram[starts[i] : starts[i + 1], starts[j] : starts[j + 1]] += np.bincount(a * len(self.books[j]) + b, minlength=len(self.books[i]) * len(self.books[j])).reshape(len(self.books[i]), -1)
        ridge = 1.0
        old = np.concatenate(self.books)
        solved = old + np.linalg.solve(gram + ridge * np.eye(total), right - gram @ old)
        self.books = [solved[a:b].astype(np.float32) for a, b in zip(starts, starts[1:])]

    def place(self, x: np.ndarray, k: int) -> np.ndarray:
        step = max(1, (1 << 22) // len(self.cells))
        return np.concatenate([_nearest(x[s : s + step], self.cells, k) for s in range(0, len(x), step)]) if len(x) else np.zeros((0, min(k, len(self.cells))), np.int64)

    def encode(self, x: np.ndarray, cell: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes by beam search, and the norms of what they stand for."""
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        norms = np.zeros(len(x), np.float32)
        for s in range(0, len(x), 2048):
            rest = (x[s : s + 2048] - self.cells[cell[s : s + 2048]])[:, None, :]
            n = len(rest)
            kept = np.zeros((n, 1, 0), np.uint8)
            for book in self.books:
                cost = (rest * rest).sum(2)[:, :, None] + (book * book).sum(1) - 2 * (rest.reshape(-1, x.shape[1]) @ book.T).reshape(n, -1, len(book))
                flat = cost.reshape(n, -1)
                width = min(beam, flat.shape[1])
                best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
                source, word = best // len(book), best % len(book)
                rest = np.take_along_axis(rest, source[:, :, None], 1) - book[word]
                kept = np.concatenate([np.take_along_axis(kept, source[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            first = (rest * rest).sum(2).argmin(1)
            codes[s : s + n] = kept[np.arange(n), first]
            norms[s : s + n] = np.linalg.norm(x[s : s + n] - rest[np.arange(n), first], axis=1)
        return codes, norms

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Estimated cosine of each query with each code of a cell, from lookup tables."""
        out = np.repeat((queries @ self.cells[cell])[:, None], len(codes), 1)
        for m, book in enumerate(self.books):
            out += (queries @ book.T)[:, codes[:, m]]
        return out / np.maximum(norms, 1e-6)


def fit(df: DataFrame, key: str, vector: str, width: int, rows: int, sample_rows: int = SAMPLE_ROWS) -> Books | None:
    """Books from about ``sample_rows`` rows, drawn by a hash of the key; null if no vector is usable."""
    share = min(1.0, sample_rows / max(rows, 1))
    rows_drawn = df.where(drawn(share, 11, key)).select(F.col(vector).cast("array<float>").alias("v")).limit(2 * sample_rows)
    sample = unit_rows(rows_drawn.toArrow().column("v"), width)[1]
    if not len(sample) and share < 1:
        sample = unit_rows(df.select(F.col(vector).cast("array<float>").alias("v")).limit(2 * sample_rows).toArrow().column("v"), width)[1]
    if not len(sample):
        return None
    return Books(sample, cells_for(rows) if rows > 8 * len(sample) else max(1, min(cells_for(rows), len(sample) // 8)))


def cells_for(rows: int) -> int:
    """Cells of an index: they grow with the rows, so that the rows each vector is compared with grow with their root."""
    return max(1, int(0.7 * math.sqrt(rows)))


def _distinct(ids: np.ndarray, x: np.ndarray, keep: int):
    """Equal vectors of one batch once: hash, place of the first, ids of up to ``keep`` smallest."""
    hashes = np.array([xxhash.xxh64_intdigest(row.tobytes()) for row in x], np.uint64).view(np.int64)
    order = np.lexsort((ids, hashes))
    first = np.ones(len(order), bool)
    first[1:] = hashes[order][1:] != hashes[order][:-1]
    starts = np.flatnonzero(first)
    members = [np.unique(ids[order[a:b]])[:keep].tolist() for a, b in zip(starts, [*starts[1:], len(order)])]
    return hashes[order[starts]], order[starts], members


def default_probes(cells: int) -> int:
    """Next cells to ask, so that the ten nearest of weakly similar vectors are met: a fixed number meets fewer the more cells there are."""
    return max(4, math.ceil(0.4 * math.sqrt(cells)))


def _best_of(by: np.ndarray, then: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Marks the k most similar rows of each value of ``by``, ties by ``then``."""
    order = np.lexsort((then, -sim, by))
    first = np.flatnonzero(np.diff(by[order], prepend=by[order[:1]] - 1)) if len(by) else np.zeros(0, int)
    rank = np.arange(len(by)) - np.repeat(first, np.diff([*first, len(by)]))
    marks = np.zeros(len(by), bool)
    marks[order[rank < k]] = True
    return marks


def neighbours(df: DataFrame, key: str, vector: str, *, k: int = 10, width: int = 64, min_similarity: float = -1.0, probes: int | None = None, rerank: int = RERANK, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The k nearest other vectors of each usable one, as far as the index finds them.

    Columns ``id, neighbour, similarity`` (exact cosine of float32 unit vectors), at most k rows an id, ties
    by the smaller id. Rows below ``min_similarity`` are left out before they travel. Vectors that are null,
    of another width, not finite or all zero take no part. Of more than k equal vectors each gets the k with
    the smallest ids. More ``probes`` find more; by default ``default_probes``, and so does more ``rerank``. An empty table gives no rows; other columns are ignored.
    """
    schema = "id long, neighbour long, similarity double"
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull())
    books = fit(rows, "id", "v", width, rows.count(), sample_rows)
    if books is None:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(books)
    span = min((default_probes(len(books.cells)) if probes is None else probes) + 1, len(books.cells))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unit_rows(batch.column("v"), width)
            if not len(at):
                continue
            hashes, first, members = _distinct(batch.column("id").to_numpy()[at], x, k + 1)
            cells = shared.value.place(x[first], span).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(members, pa.list_(pa.int64())), pa.array(list(cells), pa.list_(pa.int32()))], ["class", "members", "cells"])

    placed = cut(rows.mapInArrow(place, "class long, members array<long>, cells array<int>"))
    sizes = np.zeros((len(books.cells), 2), np.int64)  # index rows and queries of each cell; one row a cell comes here
    for r in placed.select(F.posexplode("cells").alias("probe", "cell")).groupBy("cell").agg(F.count_if(F.col("probe") == 0).alias("own"), F.count_if(F.col("probe") > 0).alias("asked")).collect():
        sizes[r.cell] = r.own, r.asked
    blocks = np.maximum(1, -(-sizes[:, 0] // block_rows))
    salts = np.maximum(1, -(-(sizes[:, 1] + sizes[:, 0] * (blocks > 1)) // query_rows))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            at, x = unit_rows(batch.column("v"), width)
            if not len(at):
                continue
            hashes, first, _ = _distinct(batch.column("id").to_numpy()[at], x, 1)
            x = x[first]
            cells = books.place(x, span)
            codes, norms = books.encode(x, cells[:, 0])
            block = (hashes.view(np.uint64) % blocks[cells[:, 0]].astype(np.uint64)).astype(np.int64)
            salt = (hashes.view(np.uint64) >> np.uint64(17)).astype(np.int64)
            who, where, asks = [], [], []
            for i in range(len(x)):
                own = cells[i, 0]
                for s in range(salts[own]):
                    who.append(i), where.append((own, block[i], s)), asks.append(False)
                for b in range(block[i] + 1, blocks[own]):
                    who.append(i), where.append((own, b, salt[i] % salts[own])), asks.append(True)
                for c in cells[i, 1:]:
                    for b in range(blocks[c]):
                        who.append(i), where.append((c, b, salt[i] % salts[c])), asks.append(True)
            who, where, asks = np.array(who), np.array(where, np.int32), np.array(asks)
            empty = np.zeros(0, np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(where[:, 0]), pa.array(where[:, 1]), pa.array(where[:, 2]), pa.array(hashes[who]), pa.array([x[i].tobytes() for i in who], pa.binary()), pa.array([empty if q else codes[i].tobytes() for i, q in zip(who, asks)], pa.binary()), pa.array(np.where(asks, np.float32(0), norms[who]))],
                ["cell", "block", "salt", "class", "x", "codes", "norm"],
            )

    def compare(group: tuple, t: pa.Table) -> pa.Table:
        books, cell, salt = shared.value, group[0].as_py(), group[2].as_py()
        classes = t.column("class").to_numpy()
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(-1, width)
        asks = np.array([len(c) == 0 for c in t.column("codes").to_pylist()])
        index = np.flatnonzero(~asks)
        index = index[np.unique(classes[index], return_index=True)[1]]  # equal vectors of several batches
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(index):
            codes = np.frombuffer(b"".join(t.column("codes").take(pa.array(index)).to_pylist()), np.uint8).reshape(len(index), -1)
            norms = t.column("norm").to_numpy()[index]
            queries = np.flatnonzero(asks)
            queries = queries[np.unique(classes[queries], return_index=True)[1]]
            if salt == 0:
                queries = np.concatenate([index, queries])
            best = min(len(index), rerank * k)
            for s in range(0, len(queries), 512):
                q = queries[s : s + 512]
                score = books.scores(x[q], cell, codes, norms)
                score[classes[q][:, None] == classes[index][None, :]] = -9
                near = np.argpartition(-score, best - 1, axis=1)[:, :best] if best < len(index) else np.tile(np.arange(best), (len(q), 1))
                exact = np.einsum("qd,qnd->qn", x[q], x[index[near]], dtype=np.float64)
                a, b = np.repeat(classes[q], best), classes[index[near]].ravel()
                keep = (a != b) & (exact.ravel() >= min_similarity)
                out.append((a[keep], b[keep], exact.ravel()[keep]))
        a, b, sim = (np.concatenate(c) for c in zip(*out))
        sim = np.minimum(sim, 1.0)
        a, b, sim = np.minimum(a, b), np.maximum(a, b), np.minimum(sim, 1.0)
        order = np.lexsort((b, a))
        once = order[np.flatnonzero(np.concatenate([order[:1] >= 0, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]))]
        a, b, sim = a[once], b[once], sim[once]
        # what is not among the k best of either side here is not among its k best at all
        best = _best_of(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sim, sim]), k)
        best = best[: len(a)] | best[len(a) :]
        return pa.table([pa.array(a[best]), pa.array(b[best]), pa.array(sim[best])], ["a", "b", "similarity"])

    met = rows.mapInArrow(spread, "cell int, block int, salt int, class long, x binary, codes binary, norm float")
    spread_rows = (sizes[:, 0] * salts + sizes[:, 0] * (blocks - 1) // 2 + sizes[:, 1] * blocks).sum()
    tasks = max(shuffle_width(df.sparkSession), int(-(-spread_rows // TASK_ROWS)))  # as many as keep each within TASK_ROWS
    pairs = met.repartition(tasks, "cell", "block", "salt").groupBy("cell", "block", "salt").applyInArrow(compare, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    pairs = cut(pairs)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    rank = lambda by, then: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("similarity"), then))
    both = both.withColumn("_r", rank("a", "b")).where(F.col("_r") <= k).drop("_r")
    # members of each class, only the first k + 1 of each
    classes = placed.groupBy("class").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))), 1, k + 1).alias("members"))
    one = placed.select("class", F.explode("members").alias("id"))
    everyone = rows_of_classes(rows, width)
    twins = everyone.join(classes.where(F.size("members") > 1), "class").select("id", F.explode("members").alias("neighbour"), F.lit(1.0).alias("similarity")).where("id <> neighbour")
    to = both.join(classes.select(F.col("class").alias("b"), "members"), "b").select("a", "similarity", F.explode("members").alias("neighbour"))
    others = to.join((one if min_similarity > 0.5 else everyone).select(F.col("class").alias("a"), "id").distinct(), "a").select("id", "neighbour", "similarity")
    found = others.unionByName(twins).distinct()
    return found.withColumn("_r", rank("id", "neighbour")).where(F.col("_r") <= k).drop("_r")


def rows_of_classes(rows: DataFrame, width: int) -> DataFrame:
    """``id, class`` of every usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unit_rows(batch.column("v"), width)
            hashes = np.array([xxhash.xxh64_intdigest(row.tobytes()) for row in x], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("id").to_numpy()[at]), pa.array(hashes)], ["id", "class"])

    return rows.mapInArrow(run, "id long, class long")


def search(df: DataFrame, queries: DataFrame, key: str, vector: str, *, k: int = 10, width: int = 64, rerank: int = 40, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The k nearest of all rows for a stated set of queries, by scanning all codes in blocks.

    Every partition scores its codes for every query by lookup tables, keeps its ``rerank * k`` best, computes
    their exact cosine and passes on k; columns as ``neighbours``. The query set is broadcast, so it must be
    small (its size is checked: at most 200,000 rows).
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull())
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull()).limit(200_001).toArrow()
    if asked.num_rows > 200_000:
        raise ValueError("more queries than fit in a broadcast; use neighbours()")
    at, q = unit_rows(asked.column("v"), width) if asked.num_rows else (np.zeros(0, int), None)
    books = fit(rows, "id", "v", width, rows.count(), sample_rows)
    schema = "id long, neighbour long, similarity double"
    if books is None or not len(at):
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast((books, asked.column("id").to_numpy()[at], q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, ids, q = shared.value
        for batch in batches:
            at, x = unit_rows(batch.column("v"), width)
            if not len(at):
                continue
            own = batch.column("id").to_numpy()[at]
            cell = books.place(x, 1)[:, 0]
            codes, norms = books.encode(x, cell)
            for s in range(0, len(q), 256):
                score = q[s : s + 256] @ books.cells[cell].T
                for m, book in enumerate(books.books):
                    score += (q[s : s + 256] @ book.T)[:, codes[:, m]]
                score /= np.maximum(norms, 1e-6)
                score[ids[s : s + 256, None] == own[None, :]] = -9
                best = min(len(own), rerank * k)
                near = np.argpartition(-score, best - 1, axis=1)[:, :best] if best < len(own) else np.tile(np.arange(best), (len(score), 1))
                exact = np.einsum("qd,qnd->qn", q[s : s + 256], x[near], dtype=np.float64)
                exact[own[near] == ids[s : s + 256, None]] = -9
                order = np.lexsort((own[near], -exact))[:, :k]
                sims = np.take_along_axis(exact, order, 1).ravel()
                other = own[np.take_along_axis(near, order, 1)].ravel()
                mine = np.repeat(ids[s : s + 256], order.shape[1])
                keep = sims > -2
                yield pa.RecordBatch.from_arrays([pa.array(mine[keep]), pa.array(other[keep]), pa.array(np.minimum(sims[keep], 1.0))], ["id", "neighbour", "similarity"])

    met = rows.mapInArrow(scan, schema)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return met.distinct().withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
