"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact reranking.

* A rotation is learnt on a bounded sample: principal directions, then alternately the signs of the
  rotated sample and the rotation nearest to those signs (orthogonal Procrustes). Random rotations
  about the origin follow, whose signs agree with a probability that only the angle of two vectors
  gives, whatever the data. Every vector is coded with all of them.
* Codes are cut into substrings, one table each. The substring width follows from the number of
  vectors, so that mean buckets keep their size; the number of tables follows from the width, so that
  at the threshold two vectors agree in some random table with probability ``RECALL`` at any width.
* First only codes are dealt: a row goes on where another one of its bucket is few enough bits away.
  Only these rows fetch their vectors, and pairs are compared by the cosine in double precision, each
  in the first table where it agrees, so nothing has to be made unique later. A large bucket is dealt
  in blocks, each pair of blocks to one task. Counts of links and spanning links leave it, not pairs.

Vectors that are equal but for a power of two are one class with a multiplicity. Defined results: vectors that are null, empty, zero,
or hold null or non-finite components link with nothing; vectors of different lengths never link; rows
that share a ``vec_id`` count as separate vectors in ``n_links``; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.components import connected_components
from skein.llm.storage import saved

SAMPLE_ROWS = 20_000
CODE_BITS = 64
ITERATIONS = 30
#: Probability that two vectors at the threshold meet in a random table, whatever their number.
RECALL = 0.99
#: Substrings are no wider than this many tables can make good for.
MAX_TABLES = 64
#: Random codes that are compared before vectors are, and the deviations that are allowed above their mean distance.
COMPARED_CODES = 3
DEVIATIONS = 5
BUCKET_ROWS = 200
BLOCK_ROWS = 1500


def learn_rotation(sample: np.ndarray, bits: int, iterations: int = ITERATIONS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation; ``bits`` is at most the number of dimensions."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    directions = vectors[:, ::-1][:, :bits]
    projected = centred @ directions
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(iterations):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ signs)
        rotation = left @ right
    return mean, directions @ rotation


def codes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = (vectors - mean) @ projection >= 0
    return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def bit_distance(threshold: float) -> float:
    """Probability that a random hyperplane parts two vectors whose cosine is ``threshold``."""
    return math.acos(min(1.0, max(-1.0, threshold))) / math.pi


def tables_needed(width: int, dimension: int, threshold: float) -> int | None:
    """How many random tables of ``width`` bits reach ``RECALL``; none where no number does."""
    parted = bit_distance(threshold)
    # in few dimensions the bits of a rotation are not nearly independent
    agree = (1 - parted) ** width if dimension >= 2 * width else 1 - width * parted
    if agree <= 0:
        return None
    return 1 if agree >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def hash_tables(n_vectors: int, dimension: int, bits: int, threshold: float) -> list[tuple[int, int]]:
    """(code, bit mask) of each table: random codes from 0, the learnt code last.

    The width is the narrowest that keeps mean buckets to about BUCKET_ROWS, and less where that would
    need more than MAX_TABLES; without any width all vectors share one bucket.
    """
    width = min(16, bits, max(4, math.ceil(math.log2(max(2, n_vectors / BUCKET_ROWS)))))
    while width and (tables_needed(width, dimension, threshold) or MAX_TABLES + 1) > MAX_TABLES:
        width -= 1
    if not width:
        return [(0, 0)]
    each = bits // width
    edges = [bits * k // each for k in range(each + 1)]
    # a mask of more than ``width`` bits would agree less often
    masks = [((1 << width) - 1) << a for a in edges[:-1]]
    needed = tables_needed(width, dimension, threshold)
    random = [(k // each, masks[k % each]) for k in range(needed)]
    return random + [(max(random[-1][0] + 1, COMPARED_CODES), mask) for mask in masks]


def random_rotation(dimension: int, bits: int, seed: int) -> np.ndarray:
    rotation, upper = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, bits)))
    return rotation * np.where(np.diag(upper) < 0, -1.0, 1.0)


def all_codes(vectors: np.ndarray, tables: list[tuple[int, int]], learnt: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of codes for each of ``vectors``, which have length one; the learnt code is the last."""
    dimension, bits = learnt[1].shape
    n_random = max(tables[-1][0], COMPARED_CODES)
    origin = np.zeros(dimension)
    return np.stack([codes(vectors, origin, random_rotation(dimension, bits, 1000 + k)) for k in range(n_random)] + [codes(vectors, *learnt)], axis=1)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)


def _codes(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).view(np.uint64)


def near_vectors(
    vectors: DataFrame,
    *,
    threshold: float = 0.9,
    sample_rows: int = SAMPLE_ROWS,
    code_bits: int = CODE_BITS,
    planned_rows: int | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding)``.

    ``planned_rows`` gives the tables the widths that so many vectors would get.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # a power of two takes very large and very small components to where squares neither overflow nor vanish, and
    # changes no cosine; adding zero makes both zeros equal
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    scaled = F.transform("embedding", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(largest))) + F.lit(0.0))
    usable_rows = rows.where(usable).withColumn("embedding", scaled)
    classes = usable_rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    sizes = [(r["d"], r["n"]) for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()]
    results = [
        _links_of_dimension(spark, classes.where(F.size("embedding") == d), d, planned_rows or n, threshold, sample_rows, min(code_bits, d, 64))
        for d, n in sizes
    ]
    if not results:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    found = saved(found, "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked"))
    components = connected_components(found.where("b is not null").select("a", "b"))
    told = (
        classes.join(counts, classes.rep == counts.a, "left")
        .join(components, F.col("rep") == F.col("node"), "left")
        .select("embedding", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    keyed = rows.withColumn("embedding", F.when(usable, scaled))
    out = keyed.join(told, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


def _links_of_dimension(spark: SparkSession, classes: DataFrame, dimension: int, n: int, threshold: float, sample_rows: int, bits: int) -> DataFrame:
    """Rows (a, b, n): spanning links with ``b``, or with ``b`` null how many vectors ``a`` has links to."""
    sample = classes.orderBy(F.xxhash64("embedding")).limit(sample_rows).select("embedding").toPandas()["embedding"]  # bounded by sample_rows
    matrix = np.stack([np.asarray(x) for x in sample])
    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    learnt = learn_rotation(matrix, bits)
    tables = hash_tables(n, dimension, bits, threshold)
    n_random = max(tables[-1][0], COMPARED_CODES)
    parted = bit_distance(threshold)
    compared_bits = COMPARED_CODES * bits
    radius = math.ceil(compared_bits * parted + DEVIATIONS * math.sqrt(compared_bits * parted * (1 - parted)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _matrix(batch["embedding"], dimension)
            found = all_codes(own / np.linalg.norm(own, axis=1, keepdims=True), tables, learnt)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], lists], names=["id", "codes"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = _codes(batch["codes"], n_random + 1)
            compared = [pa.array(found[:, k].view(np.int64)) for k in range(COMPARED_CODES)]
            for t, (c, mask) in enumerate(tables):
                key = (found[:, c] & np.uint64(mask)) >> np.uint64(max(0, (mask & -mask).bit_length() - 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t), pa.int32()), pa.array(key.astype(np.int64)), batch["id"], *compared], names=["t", "key", "id", *names])

    names = [f"code{k}" for k in range(COMPARED_CODES)]
    all_coded = saved(classes.select("id", "embedding").mapInArrow(coded, "id long, codes array<long>"), "vector-codes")
    indexed = all_coded.mapInArrow(entries, "t int, key long, id long, " + ", ".join(f"{c} long" for c in names))
    # only buckets of more than one block, n * tables / BLOCK_ROWS at most
    buckets = indexed.groupBy("t", "key").agg(F.count("*").alias("held")).where(F.col("held") > BLOCK_ROWS)
    dealt = indexed.join(F.broadcast(buckets), ["t", "key"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("held") / BLOCK_ROWS), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", *names)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a bucket that have a partner a few bits away, unless compared codes agree in an earlier table."""
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        t, i, j = (table[c][0].as_py() for c in ("t", "i", "j"))
        own = table["own"].to_numpy()
        code = np.stack([table[c].to_numpy() for c in names]).view(np.uint64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        chosen = np.zeros(len(own), dtype=bool)
        for lo in range(0, len(left), 512):
            part = left[lo : lo + 512]
            apart = sum(np.bitwise_count(c[part][:, None] ^ c[right][None, :]) for c in code)
            x, y = np.nonzero(apart <= radius)
            x, y = part[x], right[y]
            keep = x < y if i == j else np.ones(len(x), dtype=bool)
            for c, mask in tables[:t]:
                if c < COMPARED_CODES:
                    keep &= ((code[c][x] ^ code[c][y]) & np.uint64(mask)) != 0
            chosen[x[keep]] = True
            chosen[y[keep]] = True
        yield from table.select(["t", "key", "i", "j", "own", "id"]).filter(pa.array(chosen)).combine_chunks().to_batches()

    chosen = dealt.groupBy("t", "key", "i", "j").applyInArrow(choose, "t int, key long, i int, j int, own int, id long")
    fetched = chosen.join(all_coded, "id").join(classes.select("id", "rep", "copies", "embedding"), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        t, i, j = (table[c][0].as_py() for c in ("t", "i", "j"))
        own = table["own"].to_numpy()
        code, rep, copies = _codes(table["codes"].combine_chunks(), n_random + 1), table["rep"].to_numpy(), table["copies"].to_numpy()
        matrix = _matrix(table["embedding"].combine_chunks(), dimension)
        norm = np.linalg.norm(matrix, axis=1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        linked = np.zeros(len(rep), dtype=np.int64)
        parent = np.arange(len(rep))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for lo in range(0, len(left), 512):
            part = left[lo : lo + 512]
            cosine = (matrix[part] @ matrix[right].T) / (norm[part][:, None] * norm[right][None, :])
            x, y = np.nonzero(cosine >= threshold)
            x, y = part[x], right[y]
            keep = x < y if i == j else np.ones(len(x), dtype=bool)
            for c, mask in tables[:t]:  # an earlier table has compared what agrees there
                keep &= ((code[x, c] ^ code[y, c]) & np.uint64(mask)) != 0
            x, y = x[keep], y[keep]
            np.add.at(linked, x, copies[y])
            np.add.at(linked, y, copies[x])
            # a link to the first partner of each row spans what the row links to
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        counted = np.flatnonzero(linked)
        roots = np.array([root(x) for x in counted.tolist()], dtype=np.int64)
        spans = counted[roots != counted] if len(counted) else counted
        a = np.concatenate([rep[counted], rep[spans]])
        b = pa.array(np.concatenate([np.zeros(len(counted), dtype=np.int64), rep[roots[roots != counted]] if len(counted) else spans]), mask=np.append(np.ones(len(counted), bool), np.zeros(len(spans), bool)))
        yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.append(linked[counted], np.zeros(len(spans), dtype=np.int64)))], names=["a", "b", "n"])

    return fetched.groupBy("t", "key", "i", "j").applyInArrow(compare, "a long, b long, n long")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)
