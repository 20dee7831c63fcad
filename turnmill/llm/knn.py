"""Exact top-k inner-product search as a Voronoi join.

Queries and data are grouped by pivots, the rows of a group by rings around its pivot.  A summary per ring (how many rows lie within
which distance of the pivot) bounds every inner product from below and above: q.p - |q| d <= q.x <= q.p + |q| d.  Rows of data
go to one part of a ring each.  Only queries are replicated, to the parts whose upper bound reaches the lower
bound of their k-th best score; there they are solved locally, against blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.llm.common import durable, ship

#: Pivots, about a quarter of the square root of the rows within these bounds, come from a sample of SAMPLE vectors by seeded hash.
PIVOTS, SAMPLE = (16, 1024), 2048
#: Rows of data of a part; queries of a part from which on it is solved in several tasks; queries that are multiplied at once.
DATA_BLOCK, QUERY_BLOCK, AT_ONCE = 4000, 50_000, 512


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each next pivot is the sample row farthest from those before."""
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: as doubles where those hold every sum, else as 64-bit integers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    return queries.astype(np.int64) @ data.astype(np.int64).T


def _rows(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64).reshape(-1, dim) if len(column) else np.empty((0, dim), np.int64)


def integers(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, v, is_query) of the rows that take part, and the length of v: the greatest of all, shorter vectors end in zeros."""
    x = F.col(vector_col)
    used = vectors.where(F.col(id_col).isNotNull() & finite(x))
    dim = max(1, used.agg(F.max(F.size(x))).first()[0] or 0)
    whole = F.concat(F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")), F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(x)))
    return used.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")), dim


def dealt(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: int, pivots: int | None) -> tuple[DataFrame, DataFrame, int] | None:
    """Queries (query_id, v, cell, ring, part, least), as often as there are parts they must see, data (vec_id, v, cell, ring, part), once
    each, and the length of a vector.  None without rows."""
    spark = vectors.sparkSession
    ship(spark)
    used, dim = integers(vectors, is_query, id_col, vector_col, scale)
    total = used.count()
    if not total:
        return None
    sample = np.array([r["v"] for r in used.select("v", F.xxhash64(F.lit(11), "vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE).collect()], np.float64)
    centres = choose_pivots(sample, pivots or min(PIVOTS[1], max(PIVOTS[0], int(total**0.5 / 4))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack(batch["v"].to_numpy()).astype(np.int64)
            away = (rows.astype(np.float64) ** 2).sum(axis=1)[:, None] - 2 * rows.astype(np.float64) @ centres.T + (centres**2).sum(axis=1)
            group = away.argmin(axis=1)
            far = np.sqrt(((rows - centres[group]) ** 2).sum(axis=1))
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": [r.tobytes() for r in rows], "is_query": batch["is_query"], "cell": group.astype("int32"), "far": far, "ring": np.floor(np.log2(far + 1) * 4).astype("int32")})

    placed = durable(used.mapInPandas(assign, "vec_id long, v binary, is_query boolean, cell int, far double, ring int"))
    # The summary: a row per cell and ring, pivots x some tens of rings of growing width, whatever the number of vectors.
    rings = placed.groupBy("cell", "ring").agg(F.count_distinct("vec_id").alias("n"), F.count("*").alias("rows"), F.max("far").alias("far")).collect()
    cells, ring_of = np.array([r["cell"] for r in rings]), np.array([r["ring"] for r in rings])
    counts, fars = np.array([r["n"] for r in rings]), np.array([r["far"] for r in rings])
    parts = np.array([-(-r["rows"] // DATA_BLOCK) for r in rings])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), AT_ONCE):
                some = batch.iloc[i : i + AT_ONCE]
                rows = _rows(some["v"], dim).astype(np.float64)
                length = np.sqrt((rows**2).sum(axis=1))
                near = rows @ centres.T
                slack = 1e-6 * (1 + np.abs(near).max() + length.max() * fars.max())
                spread = length[:, None] * fars
                low = near[:, cells] - spread
                ranked = np.argsort(-low, axis=1)
                # One more than k, since the query's own row may be among them.
                at = (np.cumsum(counts[ranked], axis=1) > k).argmax(axis=1)
                least = low[np.arange(len(rows)), ranked[np.arange(len(rows)), at]] - slack if counts.sum() > k else np.full(len(rows), -np.inf)
                q, c = np.nonzero(near[:, cells] + spread + slack >= least[:, None])
                each = np.repeat(np.arange(len(q)), parts[c])
                part = np.arange(len(each)) - np.repeat(np.cumsum(parts[c]) - parts[c], parts[c])
                q, c = q[each], c[each]
                yield pd.DataFrame({"query_id": some["vec_id"].to_numpy()[q], "v": some["v"].to_numpy()[q], "cell": cells[c].astype("int32"), "ring": ring_of[c].astype("int32"), "part": part.astype("int32"), "least": least[q]})

    asked = placed.where("is_query").select("vec_id", "v").distinct().mapInPandas(send, "query_id long, v binary, cell int, ring int, part int, least double")
    n_parts = spark.createDataFrame([(r["cell"], r["ring"], int(n)) for r, n in zip(rings, parts, strict=True)], "cell int, ring int, parts int")
    data = placed.join(F.broadcast(n_parts), ["cell", "ring"])
    return asked, data.select("vec_id", "v", "cell", "ring", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part")), dim


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each query, ties to the smaller vec_id.

    Components become floor(scale * x).  Every row but those with the query's own id is a candidate.  Rows with a null id, or whose vector is
    null or has a null or non-finite component take no part.  Vectors of different lengths meet as if the shorter one
    ended in zeros; an empty one scores 0.  Repeated rows count once; a query without candidates gives no rows, nor does an
    empty table; other columns are ignored.
    """
    ready = dealt(vectors, is_query, k, id_col, vector_col, scale, pivots)
    if ready is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked, data, dim = ready
    keys = ["cell", "ring", "part"]
    asked = durable(asked)
    # A part that very many queries ask for is solved in several tasks; only such parts, and only then, are sent more than once.
    crowds = asked.groupBy(*keys).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("_crowd"))
    dealt_queries = asked.join(crowds.where("_crowd > 1"), keys, "left").select(*keys, F.pmod(F.xxhash64("query_id"), F.coalesce("_crowd", F.lit(1))).cast("int").alias("crowd"), F.lit(1).alias("side"), F.col("query_id").alias("id"), "v", "least")
    dealt_data = data.join(crowds, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("_crowd") - 1)).alias("crowd"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), "v", F.lit(0.0).alias("least"))
    sent = dealt_data.union(dealt_queries).repartition(*keys, "crowd").sortWithinPartitions(*keys, "crowd", "side", "id")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, held = None, np.empty(0, np.int64), []
        for batch in batches:
            place = batch[[*keys, "crowd", "side"]].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            found: list[tuple] = []
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                own, block = place[begin, :4].tolist(), batch.iloc[begin:end]
                if own != at:
                    at, ids, held = own, np.empty(0, np.int64), []
                if not place[begin, 4]:
                    ids = np.append(ids, block["id"].to_numpy())
                    held.append(_rows(block["v"], dim))
                    continue
                if len(held) > 1:
                    held = [np.concatenate(held)]
                if (ids[1:] == ids[:-1]).any():  # repeated rows, next to each other
                    first = np.unique(np.column_stack([ids, held[0]]), axis=0, return_index=True)[1]
                    ids, held = ids[first], [held[0][first]]
                for i in range(0, len(block), AT_ONCE):
                    some = block.iloc[i : i + AT_ONCE]
                    score = products(_rows(some["v"], dim), held[0])
                    for query, least, row in zip(some["id"].to_numpy(), some["least"].to_numpy(), score, strict=True):
                        fit = np.flatnonzero((row >= least) & (ids != query))
                        if len(fit) > k:
                            cut = np.partition(row[fit], len(fit) - k)[len(fit) - k]
                            fit = fit[row[fit] >= cut]
                        fit = fit[np.argsort(-row[fit], kind="stable")][:k]
                        found += zip([query] * len(fit), ids[fit], row[fit])
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    local = sent.mapInPandas(solve, "query_id long, vec_id long, score long")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
