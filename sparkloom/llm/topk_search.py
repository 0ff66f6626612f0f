"""Exact top-k search over integer vectors with an impact-ordered, score-at-a-time index.

Components become floor(256 * x), x as double; a score is an integer inner product. Rows are dealt into blocks of bounded size, and the index of
a block is built once and written. A posting is a row's component in one dimension and its impact the component's magnitude, quantised to
LEVELS impacts that about equally many postings have. The postings of one dimension and impact are a segment; zeros have none.

A query processes segments by descending impact; those of one impact, over all dimensions and for many queries, are one matrix product. A row's
score then differs from what it has so far by at most the query's norm times the norm of the row's unprocessed part, which the index
holds for each impact. A row is proven out when its upper bound is below the k-th best exact score of rows that lead so far. As soon
as the rows not proven out are so few that scoring them costs less than another impact, the query stops, and these possible members are
scored exactly. So each block gives its exact top k, and the blocks' lists are merged.

Each share of the queries meets each block's index in one task; a task holds one index and one share, both of bounded size, and no side is broadcast.
Vectors without any structure to prune by are thus compared in work that grows with rows times queries; what moves is the index once for each
QUERIES queries and the queries once for each block.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Vectors of unequal lengths are
compared as if zeros followed the shorter one. Ties go to the smaller id. A repeated candidate row counts as often as it stands; a repeated
query counts once. Numbers too large for floating point are compared as integers; of a score beyond 64 bits the column shows the closest
long, and scores beyond 2**124 rank alike. Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut

SCALE = 256
ELEMENTS = 1 << 22  #: components of a block, about
QUERIES = 8_192  #: queries of a share, at most about
TOGETHER = 64  #: queries of a share processed at once
LEVELS = 8  #: quantised impacts
FEW = 16  #: a query stops when at most one row in FEW is possible
SEEN = 1 << 16  #: components of a block that its impacts are cut by, about
LEADERS = 256  #: groups of rows whose best are looked at for the k-th best score
_LARGE = 2.0**45  #: components from here on aren't whole numbers of 53 bits when scaled
_HALF = 62  #: bits of a score's lower part


def _units(x: float) -> int:
    """floor(SCALE * x) of any finite double."""
    return math.floor(x * SCALE) if abs(x) < 2.0**900 else int(x) * SCALE


class Index:
    """The impact-ordered index of one block: vectors are rows of whole numbers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kind: type = np.float64) -> None:
        n, d = vectors.shape
        groups = max(1, min(LEADERS, n))
        self.ids, self.n, self.size = ids, n, -(-n // groups) * groups if n else 0  # rows of zeros fill the last group
        self.groups = groups
        self.vectors = vectors.astype(kind)
        impact = np.abs(self.vectors)
        some = impact.ravel()[:: max(1, impact.size // SEEN)]
        some = some[some > 0]  # where impacts are cut only matters for speed, so a sample will do
        edges = np.quantile(some, np.arange(1, LEVELS) / LEVELS) if len(some) else np.zeros(LEVELS - 1)
        level = np.where(impact > 0, LEVELS - 1 - np.searchsorted(edges.astype(kind), impact, "right"), LEVELS).astype(np.int8).T.copy()
        turned = np.zeros((d, self.size), kind)
        turned[:, :n] = self.vectors.T
        self.slabs, self.segments, self.unseen = [], [], []
        for k in range(LEVELS):  # the highest impact is level 0
            slab = turned.copy()
            slab[:, :n][level != k] = 0
            self.slabs.append(slab), self.segments.append(int((level == k).any(axis=1).sum()))
        left = np.zeros(self.size)
        for slab in reversed(self.slabs):
            self.unseen.insert(0, (np.sqrt(left) * (1 + 1e-5)).astype(kind))
            left += np.einsum("dn,dn->n", slab, slab, dtype=np.float64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Ids and scores of the k best of each query, and how many segments it has processed."""
        queries = queries.astype(self.vectors.dtype)
        found, processed = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries), np.zeros(len(queries), np.int64)
        norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)).astype(queries.dtype)
        seen = np.zeros((len(queries), self.size), queries.dtype)
        seen[:, self.n :] = -np.inf
        for b, at in enumerate(map(self._own, query_ids.tolist())):
            seen[b, at] = -np.inf
        live = np.arange(len(queries)) if self.n else np.zeros(0, np.int64)
        for level in range(LEVELS):
            if self.segments[level]:
                seen += queries[live] @ self.slabs[level]
            processed[live] += self.segments[level]
            reach = self._reach(seen, queries[live], k)
            slack = norm[live][:, None] * self.unseen[level]
            slack += seen
            possible = slack >= reach[:, None] - 1  # what rounding can take from a bound is less
            few = (np.count_nonzero(possible, axis=1) * FEW <= self.n) | (level + 1 == LEVELS)
            for b in np.flatnonzero(few).tolist():
                at = np.flatnonzero(possible[b, : self.n] & np.isfinite(seen[b, : self.n]))
                scores = (self.vectors[at] @ queries[live[b]]).astype(np.int64)
                best = np.lexsort((self.ids[at], -scores))[:k]
                found[live[b]] = self.ids[at][best], scores[best]
            live, seen = live[~few], seen[~few]
            if not len(live):
                break
        return found, processed

    def _own(self, query_id: int) -> slice:
        return slice(*np.searchsorted(self.ids, (query_id, query_id + 1)))

    def _reach(self, seen: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """The k-th best exact score of some rows that lead: a score that the k-th best of all reaches as well."""
        parts = seen.reshape(len(seen), self.groups, -1)
        best = parts.max(axis=2)
        m = min(self.groups, 2 * k + 8)
        if m < k:
            return np.full(len(seen), -np.inf, seen.dtype)
        lead = np.argpartition(best, self.groups - m, axis=1)[:, self.groups - m :]
        rows = np.arange(len(seen))[:, None]
        at = lead * parts.shape[2] + parts[rows, lead].argmax(axis=2)
        exact = np.einsum("bmd,bd->bm", self.vectors[np.minimum(at, self.n - 1)], queries)
        exact[~np.isfinite(seen[rows, at])] = -np.inf
        return np.partition(exact, m - k, axis=1)[:, m - k]


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of doubles, with zeros behind the shorter ones."""
    lists = lists.combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def _build(rows: pa.Table) -> pa.Table:
    """One row with the block's ids in order and its vectors: whole numbers as small as they go, or raw doubles if some are large."""
    width = int(max(np.diff(rows.column("vector").combine_chunks().offsets.to_numpy()), default=0))
    ids, raw, copies = rows.column("id").to_numpy(), _matrix(rows.column("vector"), width), rows.column("copies").to_numpy()
    order = np.repeat(np.argsort(ids, kind="stable"), copies[np.argsort(ids, kind="stable")])
    most = np.abs(raw).max(initial=0)
    kind = "<f8"
    if most < _LARGE:
        raw = np.floor(SCALE * raw)
        kind = next(c for c, limit in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**63)) if SCALE * most + 1 < limit)
    return pa.table({"block": rows.column("block")[:1], "width": pa.array([width], pa.int32()), "kind": [kind], "ids": pa.array([ids[order].tobytes()], pa.binary()), "vectors": pa.array([raw[order].astype(kind).tobytes()], pa.binary())})


def _exact(ids: np.ndarray, vectors: list[list[int]], query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
    scores = [(-sum(a * b for a, b in zip(v, query)), i) for v, i in zip(vectors, ids.tolist()) if i != query_id]
    return [(i, -s) for s, i in sorted(scores)[:k]]


def _best(asked: pa.Table, index: pa.Table, k: int) -> pa.Table:
    out: list[tuple[int, int, int]] = []
    if asked.num_rows and index.num_rows:
        width, kind = index.column("width")[0].as_py(), index.column("kind")[0].as_py()
        ids = np.frombuffer(index.column("ids")[0].as_py(), np.int64)
        vectors = np.frombuffer(index.column("vectors")[0].as_py(), kind).reshape(len(ids), width)
        width = max(width, int(max(np.diff(asked.column("vector").combine_chunks().offsets.to_numpy()), default=0)))
        query_ids, raw = asked.column("id").to_numpy(), _matrix(asked.column("vector"), width)
        vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
        most = math.inf
        if kind != "<f8" and np.abs(raw).max(initial=0) < _LARGE:
            queries = np.floor(SCALE * raw)
            longest = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
            most = longest(vectors) * longest(queries)  # no part of a score is beyond
        if most < 2.0**52:
            built = Index(ids, vectors, np.float32 if most < 2.0**23 else np.float64)
            for at in range(0, len(queries), TOGETHER):
                own = slice(at, at + TOGETHER)
                for query_id, (found, scores) in zip(query_ids[own].tolist(), built.search(query_ids[own], queries[own], k)[0]):
                    out += [(query_id, i, s) for i, s in zip(found.tolist(), scores.tolist())]
        else:
            whole = [[_units(x) if kind == "<f8" else int(x) for x in v] for v in vectors.tolist()]
            for query_id, query in zip(query_ids.tolist(), raw.tolist()):
                out += [(query_id, i, s) for i, s in _exact(ids, whole, query_id, list(map(_units, query)), k)]
    low = (1 << _HALF) - 1
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s >> _HALF))
    columns = [[r[0] for r in out], [r[1] for r in out], [clip(r[2]) for r in out], [r[2] & low for r in out]]
    return pa.table([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "high", "low"])


def _whole(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of vectors for each row of queries, but not its own."""
    rows, asked = (df.where(_whole(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")) for df in (vectors, queries))
    asked = asked.distinct()
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-n * max(1, width) // ELEMENTS))
    n_asked = asked.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shares = max(1, -(-n_asked // QUERIES), min(-(-cores // blocks), -(-n_asked // TOGETHER)))
    deal = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    once = rows.groupBy("id", "vector").agg(F.least(F.count("*"), F.lit(k)).alias("copies")).withColumn("block", deal(blocks))
    index = cut(once.groupBy("block").applyInArrow(_build, "block int, width int, kind string, ids binary, vectors binary"), "index")
    left = asked.withColumn("share", deal(shares)).withColumn("block", every(blocks)).groupBy("block", "share")
    right = index.withColumn("share", every(shares)).groupBy("block", "share")
    found = left.cogroup(right).applyInArrow(lambda a, b: _best(a, b, k), "query_id long, vec_id long, high long, low long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id"))
    high = F.col("high")
    score = F.when(high > 1, F.lit((1 << 63) - 1)).when(high < -2, F.lit(-(1 << 63))).otherwise(F.shiftleft(high, _HALF).bitwiseOR(F.col("low")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
