"""Approximate nearest neighbours by additive quantisation.

A unit vector is coded as a sum of one codeword from each of several codebooks. Every codebook is
full-dimensional and learnt on what the ones before it leave over; a beam of partial sums is kept
while coding. A query's inner products with all codewords are a lookup table, so a coded vector's
score is a few lookups and a division by its stored norm. The best by that score are ranked again by
the cosine of the original vectors, in double precision, and so is every other vector whose cosine may
still reach theirs: a code and the cosine of a vector with its code bound the vector's cosine with any
query. So codes lose no neighbour, however alike the vectors are.

Vectors lie in cells around coarse centroids, and a query looks into its nearest cells only. How many
is measured on the learnt vectors: so many that nearly all of their true neighbours lie in them, so
data without clusters are searched nearly whole and recall holds. It is measured for the queries'
neighbours too, as queries may be spread otherwise than other rows. Queries and vectors of a cell meet
in blocks: each block gives each query its best few, and the best of these over all blocks are the
result. Equal vectors are coded once, under their smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelflow.llm.common import settled, shared, stored

BOOKS, WORDS, BEAM = 16, 128, 4
#: Codebooks are learnt on so many vectors at most, those with the least hash; every vector is indexed.
MOST_LEARNT = 8192
#: Vectors and queries of one block, and how many of a block's vectors are ranked again for a query.
BLOCK, QUERIES, AGAIN = 16384, 2048, 256
#: Vectors to a cell on average, most cells, and the share of true neighbours that have to lie in the cells looked into.
CELL, MOST_CELLS, COVERED = 8192, 1024, 0.985


class Codebooks:
    """Codebooks for unit vectors: `words` is an array (book, word, dimension)."""

    def __init__(self, learnt: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        x = learnt.astype(np.float32)
        left, made = x.copy(), []
        for _ in range(books):
            size = min(words, max(1, len(left)))
            centre = left[rng.choice(len(left), size, replace=False)].copy() if len(left) else np.zeros((1, x.shape[1]), np.float32)
            for _ in range(rounds if len(left) else 0):
                near = self._nearest(left, centre)
                count = np.bincount(near, minlength=size)
                order = np.argsort(near, kind="stable")
                full = np.flatnonzero(count)
                centre[full] = np.add.reduceat(left[order], np.append(0, np.cumsum(count[full]))[:-1]) / count[full, None]
            if len(left):
                left = left - centre[self._nearest(left, centre)]
            made.append(np.vstack([centre, np.zeros((words - len(centre), x.shape[1]), np.float32)]))
        self.words = np.stack(made)
        flat = self.words.reshape(-1, x.shape[1])
        self.gram = flat @ flat.T

    @staticmethod
    def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.argmin((centre * centre).sum(1) - 2 * (x @ centre.T), axis=1)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (vector, book) and the norms of the coded sums, by beam search for the least error."""
        books, words, _ = self.words.shape
        n = len(x)
        dots = (x.astype(np.float32) @ self.words.reshape(books * words, -1).T).reshape(n, books, words)
        own = np.diagonal(self.gram).reshape(books, words)
        codes, error = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for m in range(books):
            # Error of adding word w: |w|^2 - 2 x.w + 2 (words so far).w
            cross = np.zeros((n, codes.shape[1], words), np.float32)
            for b in range(m):
                cross += self.gram[b * words + codes[:, :, b], m * words : (m + 1) * words]
            grown = error[:, :, None] + own[m] - 2 * dots[:, None, m] + 2 * cross
            flat = grown.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            error = np.take_along_axis(flat, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // words)[:, :, None].repeat(m, 2), 1) if m else np.zeros((n, keep, 0), np.int64), (best % words)[:, :, None]], 2)
        pick = np.argmin(error, axis=1)
        codes = codes[np.arange(n), pick]
        dot = np.take_along_axis(dots, codes[:, :, None], 2)[:, :, 0].sum(1)
        square = error[np.arange(n), pick] + 2 * dot  # |sum|^2 = error - |x|^2 + 2 x.sum, and error leaves out |x|^2
        return codes.astype(np.uint8), np.sqrt(np.maximum(square, 1e-12)).astype(np.float32)

    def aligned(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The cosine of each unit vector with its coded sum."""
        total = sum(self.words[m].take(codes[:, m], axis=0) for m in range(codes.shape[1])).astype(float)
        return ((x * total).sum(1) / np.maximum(np.sqrt((total * total).sum(1)), 1e-12)).astype(np.float32)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with all codewords: (query, book * words)."""
        return queries.astype(np.float32) @ self.words.reshape(-1, self.words.shape[2]).T


def reach(near: np.ndarray, aligned: np.ndarray) -> np.ndarray:
    """The most that a query's cosine with a vector can be, from those of the vector's code with the query and the vector; with room for rounding."""
    near, aligned = np.clip(near, -1, 1), np.clip(aligned, -1, 1)
    return near * aligned + np.sqrt((1 - near * near + 1e-5) * (1 - aligned * aligned + 1e-5)) + 1e-5


class Cells:
    """Coarse centroids of unit vectors, and how many cells a query looks into."""

    def __init__(self, learnt: np.ndarray, cells: int, k: int, covered: float = COVERED, asked: int = 512, rounds: int = 8, seed: int = 2, *, queries: np.ndarray | None = None):
        x = learnt.astype(np.float32)
        cells = max(1, min(cells, len(x) // 4))
        self.centre = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)].copy() if len(x) else np.zeros((1, x.shape[1]), np.float32)
        for _ in range(rounds if cells > 1 else 0):
            near = Codebooks._nearest(x, self.centre)
            for c in range(cells):
                if (near == c).any():
                    self.centre[c] = x[near == c].mean(0)
        self.probes = 1
        if cells > 1:
            own = Codebooks._nearest(x, self.centre)
            for some in (x[:asked], *([] if queries is None else [queries.astype(np.float32)[:asked]])):
                like = some @ x.T
                like[like > 1 - 1e-6] = -np.inf  # itself; without its near copies the others are farther, which only adds cells
                true = own[np.argpartition(-like, k - 1, axis=1)[:, :k]]  # the cells of the true neighbours
                place = np.argsort(self.order(some, cells), axis=1)
                if len(some):
                    self.probes = max(self.probes, int(np.quantile(np.take_along_axis(place, true, 1), covered, method="higher")) + 1)

    def of(self, unit: np.ndarray) -> np.ndarray:
        return Codebooks._nearest(unit.astype(np.float32), self.centre)

    def order(self, unit: np.ndarray, most: int) -> np.ndarray:
        """The nearest cells of each vector, nearest first."""
        far = (self.centre * self.centre).sum(1) - 2 * (unit.astype(np.float32) @ self.centre.T)
        return np.argsort(far, axis=1, kind="stable")[:, :most]


def usable(vector: Column, dimension: int) -> Column:
    """Vectors of this length without null or non-finite components that aren't zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimension) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _scaled(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings them near one, which leaves cosines as they are and lets no square overflow or vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, again: int = AGAIN, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by cosine for each row where `queries` holds.

    A query's candidates are all rows but those with its own id; ties go to the smaller vec_id, ranks
    count from 1, and fewer candidates give fewer rows. Takes vec_id (long) and embedding (an array of
    numbers, all of the length that is most frequent, the smallest of these); vectors null, zero, of
    another length or with null or non-finite components, and null ids, take no part. Repeated rows
    count once. Other columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    lengths = vectors.where("embedding is not null and vec_id is not null").groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), "length").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if top is None:
        return spark.createDataFrame([], schema)
    usual = vectors.where(usable(F.col("embedding"), top["length"]) & F.col("vec_id").isNotNull())
    # Of equal vectors the k + 1 smallest ids are enough, for whichever row asks.
    first = usual.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    single = settled(first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))

    learnt = single.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h", "embedding").limit(MOST_LEARNT).select("embedding").toArrow()
    x = _unit(_matrix(learnt.column("embedding"))) if learnt.num_rows else np.zeros((0, max(1, top["length"])))
    books = shared(spark, Codebooks(x))
    asked = usual.where(queries).distinct().select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    some = asked.select("query", F.xxhash64("query", "query_id").alias("h")).orderBy("h").limit(512).select("query").toArrow()
    own = _unit(_matrix(some.column("query"))) if some.num_rows else None
    cells = shared(spark, Cells(x, min(MOST_CELLS, -(-single.count() // cell)), k, queries=own))

    def coded(batches):
        own, around = books(), cells()
        for batch in batches:
            for piece in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                unit = _unit(_matrix(piece.column("embedding")))
                codes, norms = own.encode(unit)
                aligned = own.aligned(unit, codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(around.of(unit), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(aligned), piece.column("embedding"), piece.column("ids")],
                    ["cell", "code", "norm", "aligned", "embedding", "ids"],
                )

    def probing(batches):
        around = cells()
        for batch in batches:
            near = around.order(_unit(_matrix(batch.column("query"))), around.probes)
            at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("query_id", "query")), pa.array(near.ravel(), pa.int32())], ["query_id", "query", "cell"])

    index = stored(single.mapInArrow(coded, f"cell int, code binary, norm float, aligned float, embedding {kind}, ids array<long>"), "ann-index")
    asked = stored(asked.mapInArrow(probing, f"query_id long, query {kind}, cell int"), "ann-queries")
    # A cell of many vectors is several blocks, and its many queries several groups; a row for each cell.
    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    groups = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    plan = F.broadcast(settled(parts.join(groups, "cell")))
    index = index.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("embedding"), "parts").cast("int"))
    index = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    asked = asked.join(plan, "cell").withColumn("group", F.pmod(F.xxhash64("query_id", "query"), "groups").cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    index, asked = index.select("cell", "block", "group", "code", "norm", "aligned", "embedding", "ids"), asked.select("cell", "block", "group", "query_id", "query")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            own = books()
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            codes = codes + np.arange(codes.shape[1]) * own.words.shape[1]
            norms, whole = left.column("norm").to_numpy(), _matrix(left.column("embedding"))
            lengths, ids = np.sqrt((whole * whole).sum(1)), left.column("ids").to_pylist()
            smallest = np.array([i[0] for i in ids])
            aligned = left.column("aligned").to_numpy()
            asking, qid = _matrix(right.column("query")), right.column("query_id").to_pylist()
            unit, unit_asking = _unit(whole).astype(np.float32), _unit(asking).astype(np.float32)
            tables = own.tables(unit_asking)
            for r, table in enumerate(tables):
                near = table[codes].sum(1) / norms
                q, best, ranked = asking[r], [], np.zeros(len(near), bool)
                pick = np.argpartition(-near, again - 1)[:again] if len(near) > again else np.arange(len(near))
                while len(pick):
                    exact = (whole[pick] * q).sum(1) / (lengths[pick] * np.sqrt((q * q).sum()))
                    for o in np.lexsort((smallest[pick], -exact)):
                        if len(best) >= k and (-exact[o], smallest[pick[o]]) > (-best[k - 1][0], best[k - 1][1]):
                            break
                        best += [(exact[o], i) for i in ids[pick[o]] if i != qid[r]]
                        best.sort(key=lambda e: (-e[0], e[1]))
                        del best[k:]
                    ranked[pick] = True
                    if len(best) < k:
                        pick = np.flatnonzero(~ranked)
                        continue
                    # What isn't ranked yet and may be as near as the last of the best, by its code and then by a short product.
                    more = np.flatnonzero(~ranked & (reach(near, aligned) >= best[k - 1][0]))
                    ranked[more] = True
                    short = unit[more] @ unit_asking[r] if 4 * len(more) < len(unit) else (unit @ unit_asking[r])[more]
                    pick = more[short >= best[k - 1][0] - 1e-4]
                for value, i in best:
                    found["query_id"].append(qid[r])
                    found["vec_id"].append(i)
                    found["score"].append(float(value))
        return pa.table(found, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    pairs = index.groupBy("cell", "block", "group").cogroup(asked.groupBy("cell", "block", "group")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
