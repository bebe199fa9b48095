"""Exact top-k search by inner product.

Candidates are laid out in tiles and queries in blocks.  Tiles and blocks are dealt to the
rows and columns of a grid of tasks, about one for GROUP_ROWS candidates: a tile is sent to every
column, a block to every row, and the grid's sides are such that both send about as much.  A
(tile, block) pair is one matrix product, after which each query keeps its k best of the tile.  The lists are merged as a tree: per
(query, branch), where Spark also limits each task's rows before the shuffle, then per query.

Components are turned into floor(scale * x), x as double, and scores are exact integers:
products run in double precision where no sum can reach 2**52, otherwise in 64-bit integers.

Defined results: a vector that is null, or holds a null or non-finite component, takes no
part, and neither does a row with a null id; vectors meet only vectors of their own length
(an empty vector scores 0 with an empty one); rows with the query's own id are never its
result; other repeated ids are results of their own, at equal scores in id order; fewer
than k candidates give fewer rows; an empty table gives none.  A score that 64 bits can't
hold raises.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE, BLOCK, GROUP_ROWS, BRANCHES = 2048, 1024, 16384, 64


def _packer(width: int, scale: float, out: str):
    """Rows to matrices of at most ``width`` vectors of one length: (dim, n, ids, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, rows = held.pop(dim)
            ids, rows = np.concatenate(ids), np.concatenate(rows)
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([int(ids[order[0]])], pa.int64()), pa.array([ids[order].tobytes()]), pa.array([rows[order].tobytes()])],
                names=["dim", "n", "first", "ids", out],
            )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(at), int(dim))
                x = np.floor(scale * x)
                if x.size and np.abs(x).max() >= 2.0**62:
                    raise OverflowError("a component is too large for an exact score")
                x = x.astype("i8")
                for s in range(0, len(at), width):
                    a, b = held.setdefault(int(dim), ([], []))
                    room = width - sum(map(len, a))
                    a.append(ids[at[s : s + room]])
                    b.append(x[s : s + room])
                    if sum(map(len, a)) == width:
                        yield flush(int(dim))
                    if room < len(at[s : s + width]):
                        a, b = held.setdefault(int(dim), ([], []))
                        a.append(ids[at[s + room : s + width]])
                        b.append(x[s + room : s + width])
        for dim in list(held):
            if held[dim][0]:
                yield flush(dim)

    return run


def tile_best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k best in a tile whose ids ascend."""
    bound = int(np.abs(q).sum(axis=1, dtype="f8").max()) * int(np.abs(c).max()) if q.size and c.size else 0
    if bound >= 1 << 62:
        raise OverflowError("a score is too large for 64 bits")
    if bound < 1 << 52:
        scores = (q.astype("f8") @ c.astype("f8").T).astype("i8")
    else:
        scores = q @ c.T
    lowest = np.iinfo("i8").min
    scores[q_ids[:, None] == c_ids[None, :]] = lowest
    k = min(k, len(c_ids))
    if bound < 1 << 50:  # score and place in one number, so that selection breaks ties by id
        place = scores * TILE - np.arange(len(c_ids)) if bound else np.broadcast_to(-np.arange(len(c_ids)), scores.shape).copy()
        place[scores == lowest] = lowest
        best = np.argpartition(place, len(c_ids) - k, axis=1)[:, len(c_ids) - k :]
    else:
        best = np.argsort(np.where(scores == lowest, np.iinfo("i8").max, -scores), axis=1, kind="stable")[:, :k]
    got = np.take_along_axis(scores, best, axis=1)
    use = got != lowest
    return np.repeat(q_ids, k).reshape(got.shape)[use], c_ids[best][use], got[use]


def grid(n: int, n_queries: int) -> tuple[int, int]:
    """Rows for the candidates and columns for the queries: rows * queries is about columns * candidates."""
    tasks = max(1, n // GROUP_ROWS)
    rows = min(tasks, max(1, round((tasks * n / max(1, n_queries)) ** 0.5)))
    return rows, -(-tasks // rows)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of highest score, ties to the smaller id."""

    def usable(df: DataFrame) -> DataFrame:
        x = F.col(vector)
        limit = F.lit(float("inf"))
        fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < limit))
        return df.where(F.col(key).isNotNull() & x.isNotNull() & fine).select(F.col(key).cast("long").alias("id"), x.alias("x"))

    n, n_queries = vectors.count(), queries.count()
    rows, columns = grid(n, n_queries)
    blocks = max(1, n_queries // BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles = usable(vectors).mapInArrow(_packer(TILE, scale, "c"), "dim int, n int, first long, ids binary, c binary")
    tiles = tiles.withColumn("grp", F.pmod(F.xxhash64("first", "n"), F.lit(rows)).cast("int")).withColumn("col", every(columns))
    asked = usable(queries).repartition(blocks, "id").mapInArrow(_packer(BLOCK, scale, "q"), "dim int, n int, first long, ids binary, q binary")
    asked = asked.withColumn("col", F.pmod(F.xxhash64("first", "n"), F.lit(columns)).cast("int"))
    asked = asked.select("dim", F.col("n").alias("nq"), F.col("ids").alias("q_ids"), "q", "col", every(rows).alias("grp"))
    pairs = tiles.drop("first").join(asked, ["grp", "col", "dim"])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grp, dim, n, ids, c, nq, q_ids, q = (batch.column(j)[i] for j in range(8))
                dim, n, nq = dim.as_py(), n.as_py(), nq.as_py()
                found = tile_best(
                    np.frombuffer(q_ids.as_buffer(), "i8"),
                    np.frombuffer(q.as_buffer(), "i8").reshape(nq, dim),
                    np.frombuffer(ids.as_buffer(), "i8"),
                    np.frombuffer(c.as_buffer(), "i8").reshape(n, dim),
                    k,
                )
                branch = np.full(len(found[0]), grp.as_py() % BRANCHES, "i4")
                yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(branch)], names=["query_id", "vec_id", "score", "branch"])

    found = pairs.select("grp", "dim", "n", "ids", "c", "nq", "q_ids", "q").mapInArrow(product, "query_id long, vec_id long, score long, branch int")
    for by in (["query_id", "branch"], ["query_id"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def embedding_neighbours(vectors: DataFrame) -> DataFrame:
    """The 10 best of all rows for every row whose vec_id is divisible by 100."""
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
