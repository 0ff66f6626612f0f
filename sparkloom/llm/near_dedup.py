"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

Each document is read once for its set's size, a 128-bit hash of the set and MinHash values. Documents with equal sets become one node. Nodes that
share a band (four MinHash values of 32 bands) are candidates; a pair at the threshold is missed with a chance of 5e-8. Candidates are compared
sixteen MinHash values (of eight bits) at a time: a pair is dropped when, after n values of which m agree, the posterior
probability that its similarity reaches the threshold, with a uniform prior, is below TOLERANCE. What remains links nodes to groups,
and inside of a group every pair is decided exactly by its shingle sets.

In a large bucket, members are first compared with its consensus, the most frequent value at each place. Numbers of values that differ obey the triangle inequality, so whoever differs from
the consensus by little enough is a candidate for the closest member as well, and one link to it will do to bring the two together; only the others are compared one by one, in blocks of
bounded size of which every two meet in a task of their own. In a large group, every member's distance (1 less
the similarity) to a pivot, the member closest to the group's consensus, is taken first and rounded down to a ring. Distances obey the triangle inequality: two members so
close to the pivot that their distances together stay below the threshold's are linked, and two whose distances differ by more are not, so such rings are
counted as a whole. Only rings that neither rule decides are cut into blocks of bounded size and number of shingles, and every two such blocks are compared in a task
of their own. Pairs never become rows: a task counts each node's verified links, weighted by copies, and hands on a spanning forest. Classes are the connected components of
verified links. Nothing is broadcast or collected. So a group of close copies takes work in proportion to its size; one whose members are all about as far from one
another as the threshold allows takes work that grows with the square, as does the number of links that it may hold. Equal sets cost nothing.

A text of fewer than five words has one shingle of all of them. Documents without words, also those with a null text, are never linked. Repeated rows are copies, and
each gets its row of the result. With a null doc_id a row is linked like any other but never names a class that has an id; texts are looked up by a
128-bit hash of id and text, and what is found is checked by the hash of its set. Several texts of one id are several documents. Only the id and
the text are read, so other columns may have any name. A very long text is worked on by itself, as one set of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components
from .shingles import HASHES, minhashes, mix, shingle_sets
from .storage import all_of, cut, discard, one_of_each, row_mark, slices

THRESHOLD = Fraction(4, 5)
ROWS = 4  #: MinHash values of a band
STEP = 16  #: MinHash values compared at a time
TOLERANCE = 1e-7
BLOCK = 512  #: members of a bucket compared at a time
VERIFIED, SHINGLES = 256, 2_000_000  #: members of a group, and their shingles, that are verified at a time, about
RINGS = 20  #: of distances to a pivot up to the threshold's
CONSENSUS = 16  #: MinHash values that a pivot is chosen by


@lru_cache(4)
def least_matches(threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """Of the first STEP, 2 * STEP, ... values, how many must agree for a pair to stay."""
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256  # eight bits of different values agree by chance
    reaches = s >= float(threshold)
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        w = np.exp(log - log.max(axis=1, keepdims=True))
        enough = (w * reaches).sum(axis=1) / w.sum(axis=1) >= tolerance
        out.append(int(np.argmax(enough)))
    return tuple(out)


def surviving(signatures: np.ndarray, a: np.ndarray, b: np.ndarray, needed: tuple[int, ...]) -> np.ndarray:
    """Which of the pairs (a, b) of rows are still candidates after all MinHash values."""
    left = np.arange(len(a))
    same = np.zeros(len(a), np.int64)
    for k, least in enumerate(needed):
        at = slice(k * STEP, (k + 1) * STEP)
        same = same + (signatures[a[left], at] == signatures[b[left], at]).sum(axis=1)
        stay = same >= least
        left, same = left[stay], same[stay]
    return left


def set_hash(s: np.ndarray) -> bytes:
    """16 bytes: the sum of the hashes, and the xor of them, mixed."""
    return s.sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(mix(s)).tobytes()


def _signature_bytes(values: np.ndarray) -> np.ndarray:
    each = values.astype("<u4").view(np.uint8).reshape(-1, HASHES, 4)
    return np.concatenate((each[:, :, 0], each[:, :, 1:].reshape(-1, 3 * HASHES)), axis=1)


def _low(first: int = HASHES) -> Column:
    """The low bytes of the first MinHash values."""
    return F.substring("signature", 1, first).alias("signature")


def _band(b: Column) -> Column:
    return F.xxhash64(b, F.col("signature").substr(b * ROWS + 1, F.lit(ROWS)), F.col("signature").substr(b * (3 * ROWS) + HASHES + 1, F.lit(3 * ROWS)))


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (a hash of id and text), print (of the set, null without shingles), n_shingles and signature of every row.

    A signature is the low bytes of all MinHash values, by which sets are compared, and then the other three bytes of each, which only bands need.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist())
                some = [s for s in sets if len(s)]
                values = iter(_signature_bytes(minhashes(some))) if some else iter(())
                rows = [(set_hash(s), next(values).tobytes()) if len(s) else (None, None) for s in sets]
                columns = pa.array([r[0] for r in rows], pa.binary()), pa.array(list(map(len, sets)), pa.int64()), pa.array([r[1] for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), *columns], ["doc_id", "row", "print", "n_shingles", "signature"])

    rows = docs.select(F.col(key).alias("doc_id"), row_mark(key, text).alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, row binary, print binary, n_shingles long, signature binary")


def _blocks(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Each member of a group once for every two blocks that it is compared in: columns i, j and its own block, dealt and sorted by group, i and j."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node", group), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def _whole_groups(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.Table]:
    """Tables of whole groups (rows with equal group, i and j) out of sorted batches."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None and held.num_rows else table
        keys = [table.column(c).to_numpy() for c in (group, "i", "j")]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        last = int(change[-1]) + 1 if len(change) else 0
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield held


def _bounds(table: pa.Table, group: str) -> list[int]:
    keys = [table.column(c).to_numpy() for c in (group, "i", "j")]
    return [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), table.num_rows]


def _roots(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place the smallest node that the links (a, b) between places connect it with; equal nodes are one."""
    names, place = np.unique(node, return_inverse=True)
    a, b, root = place[a], place[b], np.arange(len(names))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return names[root][place]
        root = new


def _pairs(first: int, last: int, block: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    if i == j:
        a, b = np.triu_indices(last - first, 1)
        return a + first, b + first
    left, right = np.flatnonzero(block[first:last] == i) + first, np.flatnonzero(block[first:last] == j) + first
    return np.repeat(left, len(right)), np.tile(right, len(left))


def _linked(threshold: Fraction, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = least_matches(threshold, tolerance)
        for table in _whole_groups(batches, "key"):
            node, block, i, j = (table.column(c).to_numpy() for c in ("node", "block", "i", "j"))
            signatures = _signatures(table)
            bounds, edges, a, b, n = _bounds(table, "key"), [], [], [], 0
            for first, last in zip(bounds, bounds[1:]):
                x, y = _pairs(first, last, block, i[first], j[first])
                a.append(x), b.append(y)
                n += len(x)
                if n > 100_000 or last == len(node):
                    x, y = np.concatenate(a), np.concatenate(b)
                    for at in range(0, len(x), 100_000):
                        stay = surviving(signatures, x[at : at + 100_000], y[at : at + 100_000], needed) + at
                        edges.append((x[stay], y[stay]))
                    a, b, n = [], [], 0
            x, y = (np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, np.int64) for k in (0, 1))
            root = _roots(node, x, y)
            links = np.unique(np.stack((node, root))[:, root != node], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links], ["a", "b"])

    return run


def _signatures(table: pa.Table | pa.RecordBatch, column: str = "signature") -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint8).reshape(-1, HASHES)


def _consensus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and consensus, the most frequent MinHash value (eight bits) at each place, of rows (key, i, j, signature) sorted by key."""
    for table in _whole_groups(batches, "key"):
        values, bounds = _signatures(table), _bounds(table, "key")
        modes = [bytes(np.bincount(column, minlength=256).argmax() for column in values[a:b].T) for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks().take(pa.array(bounds[:-1])), pa.array(modes, pa.binary())], ["key", "consensus"])


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        other = np.frombuffer(b"".join(batch.column("consensus").to_pylist()), np.uint8).reshape(-1, HASHES)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), pa.array((_signatures(batch) != other).sum(axis=1).astype(np.int32))], ["key", "node", "h"])


def _large_buckets(hits: DataFrame, threshold: Fraction, tolerance: float, made: list[DataFrame]) -> DataFrame:
    """Edges a, b that connect the members of each large bucket that may reach the threshold; hits: a written table of key, node, size and signature (low bytes)."""
    most = HASHES - least_matches(threshold, tolerance)[-1]  # so many values of a candidate pair may differ
    some = hits.where(F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("size") / BLOCK)) == 0)  # about a block's members
    some = some.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "signature").repartition("key").sortWithinPartitions("key")
    consensus = cut(some.mapInArrow(_consensus, "key long, consensus binary"), "consensus")
    spread = cut(hits.select("key", "node", "signature").join(consensus, "key").mapInArrow(_differing, "key long, node long, h int"), "spread")
    made += [consensus, spread]
    alone = hits.select("key", "node").join(consensus, "key", "left_anti").withColumn("h", F.lit(HASHES))  # a hash may leave the sample of a bucket empty
    spread = spread.unionByName(alone)
    core = spread.groupBy("key").agg(F.min("h").alias("least"), F.min_by("node", F.struct("h", "node")).alias("core"))
    rows = spread.join(core, "key").withColumn("out", F.col("h") > most - F.col("least"))
    star = rows.where(~F.col("out") & (F.col("node") != F.col("core"))).select(F.col("node").alias("a"), F.col("core").alias("b"))
    blocks = lambda n: F.ceil(F.count_if(n) / BLOCK).cast("int")
    counts = rows.groupBy("key").agg(blocks(F.col("out")).alias("outer"), blocks(~F.col("out")).alias("inner")).where("outer > 0")
    rows = rows.join(counts, "key")
    part = lambda n: F.pmod(F.xxhash64("node", "key"), F.greatest(n, F.lit(1))).cast("int")
    rows = rows.withColumn("block", F.when(F.col("out"), part(F.col("outer"))).otherwise(F.col("outer") + part(F.col("inner"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("out"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).join(hits.select("key", "node", "signature"), ["key", "node"])
    dealt = rows.select("key", "i", "j", "block", "node", "signature").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return star.unionByName(dealt.mapInArrow(_linked(threshold, tolerance), "a long, b long"))


def links_inside(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Which of the rows left are linked with which of the rows right, as a matrix of booleans."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[place] > 1
    place, owner = np.unique(place[shared], return_inverse=True)[1] if shared.any() else place[shared], owner[shared]
    both = np.zeros((len(left), len(right)))
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4_096):
        a, b = np.searchsorted(place, (low, low + 4_096))
        own = np.zeros((len(sets), 4_096), np.float32)
        own[owner[a:b], place[a:b] - low] = 1
        both += own[left] @ own[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both * threshold.denominator >= union * threshold.numerator


def _verified(threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "component"):
            node, block, i, j, copies = (table.column(c).to_numpy() for c in ("node", "block", "i", "j", "copies"))
            links, root = np.zeros(len(node), np.int64), node.copy()
            shingles = table.column("shingles")
            bounds = _bounds(table, "component")
            for first, last in zip(bounds, bounds[1:]):
                sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in shingles.slice(first, last - first)]
                left, right = (np.flatnonzero(block[first:last] == x[first]) for x in (i, j))
                if not len(left) or not len(right) or len(sets) < 2:
                    continue
                linked = links_inside(sets, left, right, threshold)
                if i[first] == j[first]:
                    np.fill_diagonal(linked, False)
                    links[first + left] += linked @ copies[first + right]
                else:
                    links[first + left] += linked @ copies[first + right]
                    links[first + right] += linked.T @ copies[first + left]
                a, b = np.nonzero(linked)
                root[first:last] = _roots(node[first:last], left[a], right[b])
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (node, links, root)], ["node", "links", "root"])

    return run


def _rings(threshold: Fraction):
    """Of rows (component, node, copies, shingles, pivot, core: the pivot's shingles) the ring of each node, and whether it is linked with the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, core in zip(batch.column("shingles"), batch.column("core")):
                own, core = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(core.as_buffer(), np.uint64)
                both = len(np.intersect1d(own, core, assume_unique=True))
                union = len(own) + len(core) - both
                apart = RINGS * (union - both) * threshold.denominator
                rows.append((apart // (union * (threshold.denominator - threshold.numerator)), both * threshold.denominator >= union * threshold.numerator))
            columns = [batch.column(c) for c in ("component", "node", "copies", "pivot")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_())], ["component", "node", "copies", "pivot", "ring", "close"])

    return run


def _pivots(large: DataFrame, nodes: DataFrame) -> DataFrame:
    """component and pivot: of each component the node that agrees best with its members' most frequent MinHash values (eight bits)."""
    value = lambda k: F.col("signature").substr(k + 1, F.lit(1))
    rows = large.select("component", "node").join(nodes.select("node", _low(CONSENSUS)), "node")
    each = rows.select("component", "node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(CONSENSUS - 1)), value)).alias("at", "value"))
    counts = each.groupBy("component", "at", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("component", "at").agg(F.max(F.struct("n", "value")).alias("x")).groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("at", "x.value"))).alias("modes"))
    agree = F.aggregate(F.sequence(F.lit(0), F.lit(CONSENSUS - 1)), F.lit(0), lambda n, k: n + (F.element_at("modes", k) == value(k)).cast("int"))
    return rows.join(best, "component").select("component", "node", agree.alias("agree")).groupBy("component").agg(F.max_by("node", F.struct("agree", -F.col("node"))).alias("pivot"))


def _decided(members: DataFrame, nodes: DataFrame, threshold: Fraction, made: list[DataFrame]) -> DataFrame:
    """node, links and root of the nodes of components that are verified in blocks; members: component, node, copies, size, shingles_all and shingles."""
    pivots = cut(_pivots(members, nodes), "pivots")
    cores = pivots.join(members.select(F.col("node").alias("pivot"), F.col("shingles").alias("core")), "pivot")
    near = members.select("component", "node", "copies", "shingles").join(cores, "component").select("component", "node", "copies", "shingles", "pivot", "core")
    near = cut(near.mapInArrow(_rings(threshold), "component long, node long, copies long, pivot long, ring int, close boolean"), "rings")
    made += [pivots, near]
    rings = near.groupBy("component", "ring").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).groupBy("component").agg(F.collect_list(F.struct("ring", "n", "copies")).alias("rings"))
    rows = near.join(rings, "component")
    own = F.col("ring")
    surely = lambda r: own + r["ring"] + 2 <= RINGS
    never = lambda r: F.abs(own - r["ring"]) - 1 >= RINGS
    certain = F.aggregate("rings", F.lit(0).cast("long"), lambda n, r: n + F.when(surely(r), r["copies"]).otherwise(0)) - F.when(own + own + 2 <= RINGS, F.col("copies")).otherwise(0)
    known = rows.select("node", certain.alias("links"), F.when(F.col("close"), F.col("pivot")).otherwise(F.col("node")).alias("root"))
    open_ = rows.withColumn("rings", F.filter("rings", lambda r: ~surely(r) & ~never(r))).where("size(rings) > 0").select("node", "ring", "rings")
    together = F.greatest(F.least(F.lit(VERIFIED), F.floor(F.col("size") * SHINGLES / F.col("shingles_all"))), F.lit(1))
    blocks = lambda n: F.ceil(n / F.col("together"))
    name = lambda ring, part: F.shiftleft(ring.cast("long"), 32) + part
    rows = members.withColumn("together", together).join(open_, "node")
    rows = rows.join(near.groupBy("component", "ring").agg(F.count("*").alias("mine")), ["component", "ring"])
    rows = rows.withColumn("block", name(own, F.pmod(F.xxhash64("node", "component"), blocks(F.col("mine")))))
    others = F.flatten(F.transform("rings", lambda r: F.transform(F.sequence(F.lit(0).cast("long"), blocks(r["n"]) - 1), lambda k: name(r["ring"], k))))
    rows = rows.withColumn("other", F.explode(others)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = rows.select("component", "i", "j", "block", "node", "copies", "shingles").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return known.unionByName(dealt.mapInArrow(_verified(threshold), "node long, links long, root long"))


def _with_shingles(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of wanted (row, print, ...) without these two, but with the shingles of their texts."""
    kinds = wanted.drop("row", "print").schema
    rows = docs.select(row_mark(key, text).alias("row"), F.col(text).cast("string").alias("text")).join(wanted.hint("shuffle_hash"), "row").select(*kinds.names, "print", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist())
                own = [set_hash(s) == p for s, p in zip(sets, part.column("print").to_pylist())]
                out = pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array([s.tobytes() for s in sets], pa.binary())], [*kinds.names, "shingles"])
                yield out.filter(pa.array(own, pa.bool_()))

    found = rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", shingles binary")
    return found


def _classes(docs: DataFrame, threshold: Fraction, tolerance: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and of each set (print, n_shingles) its class_id, the row that stays for the class, and n_links."""
    rows = cut(sketch(docs, key, text), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row")).alias("first")
    sets = rows.where("print IS NOT NULL").groupBy("print", "n_shingles").agg(first, F.count("*").alias("copies"), F.first("signature").alias("signature"))
    nodes = cut(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")  # a number of its own for each set, once the table is written
    n_bands = HASHES // ROWS
    bands = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), _band)).alias("key"))
    shared = cut(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    hits = cut(bands.join(shared, "key"), "hits")  # small beside the bands and signatures, and read for either kind of bucket
    signed = lambda rows: rows.join(nodes.select("node", _low()), "node")
    edges = _blocks(signed(hits.where(F.col("size") <= BLOCK)), "key", F.lit(1)).select("key", "i", "j", "block", "node", "signature").mapInArrow(_linked(threshold, tolerance), "a long, b long")
    made = [hits]
    if not shared.where(F.col("size") > BLOCK).isEmpty():
        made.append(cut(signed(hits.where(F.col("size") > BLOCK)), "large"))
        edges = edges.unionByName(_large_buckets(made[-1], threshold, tolerance, made))
    grouped = components(edges.distinct())
    discard(*made)
    sizes = cut(grouped.join(nodes.select("node", "n_shingles"), "node").groupBy("component").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles_all")), "sizes")
    wanted = grouped.join(sizes, "component").join(nodes.select("node", F.col("first.row").alias("row"), "print", "copies"), "node")
    members = cut(_with_shingles(docs, wanted, key, text).dropDuplicates(["node"]), "members")
    whole = (F.col("size") <= VERIFIED) & (F.col("shingles_all") <= SHINGLES)
    found = _blocks(members.where(whole), "component", F.lit(1)).select("component", "i", "j", "block", "node", "copies", "shingles").mapInArrow(_verified(threshold), "node long, links long, root long")
    made = [members]
    large = members.where(~whole)
    if not large.isEmpty():
        found = found.unionByName(_decided(large, nodes, threshold, made))
    verified = cut(found, "verified")
    discard(*made)
    classes = components(verified.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.select("node", "print", "n_shingles", "first", "copies").join(links, "node", "left").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    named = joined.groupBy("class").agg(F.min("first").alias("stays"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    info = cut(joined.join(named, "class").select("print", "n_shingles", F.col("stays.doc_id").alias("class_id"), F.col("stays.row").alias("stays"), n_links.alias("n_links")), "classes")
    discard(nodes, shared, grouped, sizes, verified, classes)
    return rows, info


def near_classes(docs: DataFrame, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and n_links (other documents at the threshold or above) of every row."""
    rows, info = _classes(docs, threshold, tolerance, key, text)
    found = rows.select("doc_id", "print", "n_shingles").join(info.drop("stays"), ["print", "n_shingles"], "left")
    return found.select("doc_id", F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, that of its smallest doc_id (a null one only where no row of the class has any), and all rows without words."""
    rows, info = _classes(docs, THRESHOLD, TOLERANCE, "doc_id", "text")
    stay = info.select(F.col("stays").alias("row")).distinct()
    repeated = cut(rows.where("print IS NOT NULL").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").join(stay, "row", "left_semi").select(F.col("row").alias("__row")), "repeated")
    wordless = rows.where("print IS NULL").select("row").distinct()
    marked = docs.withColumn("__row", row_mark("doc_id", "text"))
    kept = marked.join(stay.unionByName(wordless).select(F.col("row").alias("__row")).hint("shuffle_hash"), "__row", "left_semi")
    if repeated.isEmpty():
        return kept.select(*all_of(docs))
    several = one_of_each(kept.join(repeated.hint("shuffle_hash"), "__row", "left_semi"), "__row", docs.columns)
    return kept.join(repeated.hint("shuffle_hash"), "__row", "left_anti").select(*all_of(docs)).unionByName(several)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
