"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its word shingles; its sketch the k smallest of them.
Documents with equal sets form one class, and only one of each class takes part in the search.

* Inverted lists of retained values: of a class's ``index_k`` smallest values only the rarest are
  listed, so many that two classes as similar as asked share a listed value unless their sketches
  overlap far less than they must (five standard deviations; for sets no larger than the sketch the
  bound is exact). Value frequencies count all classes. The few values that are in very many lists
  are told by a broadcast table whose size is bounded by the ratio that makes a value frequent.
* Pairs are not enumerated within a list. In a few rounds each list names one member, and every class
  is compared with the member that most of its lists name. What is linked shares a label from then on.
* What is compared at all has sizes that fit and masks of the retained values that differ no more than the lists allow, so
  pairs that share a value by chance are told without their sketches.
* Members of a list with different labels are compared by their sketches: pairs of lists of ``SHORT_LIST``
  members at most once each, longer lists block by block inside tasks. What has a possible partner
  fetches its text, and lists or blocks are confirmed inside tasks. Only links that connect something
  new leave them, so neither pairs nor links are emitted for each pair of a group.
* Estimation: the values that both sketches would retain, and how many of them both have, estimate the
  Jaccard similarity; pairs four deviations below the threshold go no further.
* The rest are confirmed on the full sets, made anew from both texts.

Defined results: documents without words and null texts have an empty set and link with nothing;
a text shorter than a shingle counts as one shingle; rows that share a ``doc_id`` and have words share
one component, with all links that any of their texts has; rows without ``doc_id`` are separate documents and have no
component of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import textscan
from skein.llm.components import connected_components
from skein.llm.storage import Scope

SKETCH_K = 128
INDEX_K = 32
STAR_ROUNDS = 2
#: A value in more than this share of all list entries is frequent; there are at most FREQUENT_PARTS such values.
FREQUENT_PARTS = 20_000
#: Pairs of a list of so few members are told by a join; longer lists are compared in blocks.
SHORT_LIST = 8
BLOCK_ROWS = 1024
#: So many nodes are broadcast at most, 8 to 48 bytes each; beyond that tables are joined by shuffles.
TOLD_NODES = 500_000
#: Columns of a block's table of values that are multiplied at once.
VALUE_COLUMNS = 4096
#: Bits that tell which of its ``index_k`` smallest values a class has, several values to a bit.
MASK_BITS = 128
SKETCHED = "doc_id long, text_key long, n_shingles long, digest binary, low array<long>, sketch array<int>, mask0 long, mask1 long"
LISTED = "value long, i int, j int, own int, node long, label long, n_shingles long, sketch array<int>, listed array<long>"


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    data = textscan.LOWER[data]
    starts, ends, rows = textscan.words(offsets, data, textscan.SPACED)
    hashes = textscan.prime_hashes(data, starts, ends)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    runs = textscan.shingle_hashes(hashes, size)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1] >> np.uint64(1))  # 63 bits: signed and unsigned order agree
        else:  # the whole sequence is one shingle
            yield textscan.shingle_hashes(hashes[a:b], b - a) >> np.uint64(1) if b > a else hashes[:0]


def sketch_documents(docs: DataFrame, *, shingle_words: int, sketch_k: int = SKETCH_K, index_k: int = INDEX_K) -> DataFrame:
    """``low`` has the ``index_k`` smallest hashes, ``sketch`` the upper halves of the ``sketch_k`` smallest."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in textscan.chunks(batch["text"]):
                sizes, digests, lows, sketches = [], [], [], []
                for hashes in shingle_sets(offsets, data, shingle_words):
                    sizes.append(len(hashes))
                    digests.append(blake2b(hashes.tobytes(), digest_size=16).digest())
                    lows.append(hashes[:index_k].view(np.int64))
                    sketches.append((hashes[:sketch_k] >> np.uint64(32)).astype(np.int32))
                bits = masks(lows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(lo, hi - lo) for c in ("doc_id", "text_key")), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(lows, np.int64), _lists(sketches, np.int32), *(pa.array(x) for x in bits)],
                    names=[c.split()[0] for c in SKETCHED.split(", ")],
                )

    return _keyed(docs).mapInArrow(sketch, SKETCHED)


def masks(lows: list[np.ndarray]) -> list[np.ndarray]:
    """Each document's ``MASK_BITS`` bits, 64 in each array."""
    bits = np.zeros((len(lows), MASK_BITS), dtype=bool)
    bits[np.repeat(np.arange(len(lows)), [len(x) for x in lows]), np.concatenate([np.zeros(0, np.int64), *lows]) % MASK_BITS] = True
    return list(np.packbits(bits, axis=1).view(np.int64).T)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    bounds = np.append(0, np.cumsum([len(x) for x in arrays]))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *arrays])))


def least_overlap(n: int, index_k: int, tenths: int) -> int:
    """How many of its ``index_k`` smallest values a document shares with any that is similar enough."""
    # where the partner's set also fits in the sketch, all shared shingles are retained
    if n * 100 <= index_k * tenths:
        return max(1, -(-n * tenths // 100))
    mean, deviation = index_k * tenths / 100, (index_k * tenths * (100 - tenths)) ** 0.5 / 100
    return max(1, int(mean - 5 * deviation))


def _overlap(n: str, index_k: int, percent: int) -> str:
    """``least_overlap`` of column ``n`` in SQL."""
    return "CASE " + " ".join(f"WHEN {n} = {k} THEN {least_overlap(k, index_k, percent)}" for k in range(index_k)) + f" ELSE {least_overlap(index_k, index_k, percent)} END"


def listed_values(lows: DataFrame, scope: Scope, *, index_k: int, percent: int) -> DataFrame:
    """Inverted lists (value, node, members) of each class's rarest retained values; lists of one member are left out."""
    entries = lows.select("node", F.explode("low").alias("value"))
    counts = scope.saved(entries.groupBy("value").agg(F.count("*").alias("df")), "value-counts")
    total = counts.agg(F.sum("df")).first()[0] or 0
    limit = max(100, total // FREQUENT_PARTS)
    frequent = counts.where(F.col("df") > limit)  # at most FREQUENT_PARTS rows
    entries = entries.join(F.broadcast(frequent.withColumnRenamed("df", "often")), "value", "left")
    told = entries.where("often is not null").select("node", "value", F.col("often").alias("df"))
    rare = entries.where("often is null").join(counts.where(F.col("df") <= limit), "value").select("node", "value", "df")
    ordered = told.union(rare).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("all"))  # index_k entries at most
    ordered = ordered.withColumn("n", F.size("all")).withColumn("kept", F.slice("all", F.lit(1), F.greatest(F.lit(1), F.col("n") - F.expr(_overlap("n", index_k, percent)) + 1)))
    kept = ordered.select("node", F.explode("kept").alias("e")).where("e.df > 1").select(F.col("e.value").alias("value"), "node")
    kept = scope.saved(kept, "kept-values")
    # others may have the value, but list rarer ones
    members = kept.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    return kept.join(members, "value").select("value", "node", "members")


def _of(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``table`` with one of the ``nodes``; only these are shuffled, where the nodes are few enough to be told to all tasks."""
    return table.join(F.broadcast(nodes), "node", "left_semi") if nodes.count() <= TOLD_NODES else table


def _told(table: DataFrame, n: int) -> DataFrame:
    """``table`` of ``n`` rows of a node and a number or two, broadcast if that is few enough."""
    return F.broadcast(table) if n <= TOLD_NODES else table


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def estimated(pairs: DataFrame, reps: DataFrame, sketch_k: int) -> DataFrame:
    """Add to ``pairs(a, b)`` the similarity estimated from the bottom-k of the union."""
    reps = _of(reps.select("node", "sketch"), _ends(pairs))
    left = reps.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, sketch_k))
    shared = F.size(F.array_intersect(F.col("u"), F.array_intersect("sa", "sb")))
    return both.select(*pairs.columns, (shared / F.greatest(F.size("u"), F.lit(1))).alias("estimate"))


#: What tells of most pairs that they can't be similar enough: the set's size, how many of its smallest values a
#: similar set may lack, and a mask of those values.
SIZED = ("n_shingles", "spare", "mask0", "mask1")


def _as(end: str) -> list:
    return [F.col(c).alias(f"{c}_{end}") for c in SIZED]


def _fitting(percent: int) -> str:
    """Whether sizes fit, and whether neither class lacks more of the other's smallest values than the lists allow.

    Each bit that one mask has and the other lacks stands for a value that is lacking, at least.
    """
    lacks = lambda x, y: f"bit_count(mask0_{x} & ~mask0_{y}) + bit_count(mask1_{x} & ~mask1_{y}) <= spare_{x}"
    return f"n_shingles_a * 100 >= n_shingles_b * {percent} and n_shingles_b * 100 >= n_shingles_a * {percent} and {lacks('a', 'b')} and {lacks('b', 'a')}"


def confirmed(pairs: DataFrame, texts: DataFrame, *, shingle_words: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are similar enough; each pair brings both texts to one task."""
    texts = _of(texts, _ends(pairs))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([h for _, _, o, d in textscan.chunks(batch[c]) for h in shingle_sets(o, d, shingle_words)] for c in ("ta", "tb"))
            mask = pa.array([_similar(x, y, percent) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared)


def _ragged(column: pa.ChunkedArray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(each list, all their values, the list that each value is in)."""
    column = column.combine_chunks()
    bounds, values = column.offsets.to_numpy(), column.values.to_numpy()
    lists = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return lists, values[bounds[0] : bounds[-1]], np.repeat(np.arange(len(lists)), np.diff(bounds))


def _shared(values: np.ndarray, row: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """How many values each of the ``left`` rows has in common with each of ``n`` rows."""
    out = np.zeros((len(left), n), dtype=np.float32)
    _, column = np.unique(values, return_inverse=True)
    often = np.bincount(column) > 1
    number = np.cumsum(often) - 1
    row, column = row[often[column]], number[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(often.sum()), VALUE_COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + VALUE_COLUMNS])
        has = np.zeros((n, min(VALUE_COLUMNS, int(often.sum()) - lo)), dtype=np.float32)
        has[row[a:b], column[a:b] - lo] = 1
        out += has[left] @ has.T
    return out


def _possible(table: pa.Table, left: np.ndarray, *, percent: int, sketch_k: int, cut: float) -> np.ndarray:
    """Estimates of pairs (left, any) of a block that this block must look at, and zero for all others."""
    value, i, j = (table[c][0].as_py() for c in ("value", "i", "j"))
    own, node, label, n = (table[c].to_numpy() for c in ("own", "node", "label", "n_shingles"))
    sketches, flat, of = _ragged(table["sketch"])
    listed, of_listed = _ragged(table["listed"])[1:]
    share = _shared(flat, of, left, len(node))
    # a sketch retains what is no larger than its last value; a small set is retained whole
    last = np.array([np.iinfo(np.int32).max if m <= sketch_k else x[-1] for x, m in zip(sketches, n.tolist(), strict=True)])
    union = -share
    for k, x in enumerate(left):
        union[k] += np.searchsorted(sketches[x], np.minimum(last[x], last), side="right")
    for y in range(len(node)):
        union[:, y] += np.searchsorted(sketches[y], np.minimum(last[y], last[left]), side="right")
    estimate = share / np.maximum(union, 1)
    near = (estimate >= cut) & (label[left][:, None] != label[None, :]) & (100 * n[left][:, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[left][:, None])
    if i != j:
        near &= own[left][:, None] != own[None, :]
    if near.any():  # a pair belongs to the least value that both list
        less = listed < value
        near &= _shared(listed[less], of_listed[less], left, len(node)) == 0
    return np.where(near, estimate, 0)


def crossing_links(lists: DataFrame, reps: DataFrame, texts: DataFrame, labels: DataFrame, sized: DataFrame, tried: DataFrame | None, n_listed: int, scope: Scope, *, shingle_words: int, percent: int, sketch_k: int, cut: float) -> DataFrame:
    """Links (a, b) between classes that share a list and have different labels, as many as connect something new.

    Lists are cut into blocks, and each pair of blocks is compared in one task. Pairs (a, b) of short lists
    that were ``tried`` before are not estimated again.
    """
    mixed = lists.join(_told(labels, n_listed), "node")
    several = mixed.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("value")
    mixed = scope.saved(mixed.join(several, "value"), "mixed")
    few = mixed.where(F.col("members") <= SHORT_LIST).join(_told(sized, n_listed), "node")
    x, y = (few.select("value", F.col("node").alias(c), F.col("label").alias(f"label_{c}"), *_as(c)) for c in "ab")
    met = x.join(y, "value").where(f"a < b and label_a != label_b and {_fitting(percent)}")
    met = met.groupBy("a", "b").agg(F.min("value").alias("value"))
    if tried is not None:
        met = met.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    met = scope.saved(met, "met")
    near = estimated(met, reps, sketch_k).where(F.col("estimate") >= cut)
    near = scope.saved(near.select("value", F.explode(F.array("a", "b")).alias("node")).distinct(), "near")
    short = near.join(_told(labels, n_listed), "node").join(_of(reps.select("node", "n_shingles", "sketch"), near.select("node").distinct()), "node")
    here = lambda n: F.lit(n).cast("int")
    columns = [c.split()[0] for c in LISTED.split(", ")]
    short = short.select(*columns[:1], here(0).alias("i"), here(0).alias("j"), here(0).alias("own"), "node", "label", "n_shingles", "sketch", F.array().cast("array<long>").alias("listed"))

    mixed = mixed.where(F.col("members") > SHORT_LIST)
    values = mixed.groupBy("node").agg(F.sort_array(F.collect_list("value")).alias("listed"))  # index_k at most
    mixed = mixed.withColumn("blocks", F.ceil(F.col("members") / BLOCK_ROWS).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    mixed = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mixed = mixed.select("value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")
    mixed = mixed.join(_of(reps.select("node", "n_shingles", "sketch"), values.select("node")).join(values, "node"), "node").select(*columns)
    options = {"percent": percent, "sketch_k": sketch_k, "cut": cut}

    def choose(table: pa.Table) -> pa.Table:
        """Members that have a possible partner with another label."""
        table = table.combine_chunks()
        label = table["label"].to_numpy()
        _, at, counts = np.unique(label, return_inverse=True, return_counts=True)
        left = np.flatnonzero(at != counts.argmax())  # every such pair has a member outside the commonest label
        chosen = np.zeros(len(label), dtype=bool)
        if len(left):
            x, y = np.nonzero(_possible(table, left, **options))
            chosen[left[x]] = True
            chosen[y] = True
        # Spark marks the elements of a collected list as never null
        kinds = pa.schema([pa.field("sketch", pa.list_(pa.int32())), pa.field("listed", pa.list_(pa.int64()))])
        fields = [kinds.field(f.name) if f.name in kinds.names else pa.field(f.name, f.type) for f in table.schema]
        return table.filter(pa.array(chosen)).cast(pa.schema(fields))

    blocks = ["value", "i", "j"]
    chosen = scope.saved(mixed.groupBy(*blocks).applyInArrow(choose, LISTED).union(short), "possible")

    def confirm(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, label = table["node"].to_numpy(), table["label"].to_numpy()
        possible = np.triu(_possible(table, np.arange(len(node)), **options), 1)
        x, y = np.nonzero(possible)
        likely = np.argsort(-possible[x, y], kind="stable")
        sets = [h for _, _, o, d in textscan.chunks(table["text"]) for h in shingle_sets(o, d, shingle_words)]
        parent = {k: k for k in label.tolist()}

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        links = []
        for a, b in zip(x[likely].tolist(), y[likely].tolist(), strict=True):
            u, v = root(int(label[a])), root(int(label[b]))
            if u != v and _similar(sets[a], sets[b], percent):
                parent[u] = v
                links.append((node[a], node[b]))
        return pa.table({c: pa.array([z[k] for z in links], pa.int64()) for k, c in enumerate("ab")})

    return chosen.join(_of(texts, chosen.select("node").distinct()), "node").groupBy(*blocks).applyInArrow(confirm, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    *,
    shingle_words: int,
    percent: int = 80,
    sketch_k: int = SKETCH_K,
    index_k: int = INDEX_K,
    star_rounds: int = STAR_ROUNDS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``.

    Two documents are linked if 100 * intersection >= percent * union; components are of the whole graph.
    """
    scope = Scope(docs.sparkSession)
    sketched = scope.saved(sketch_documents(docs, shingle_words=shingle_words, sketch_k=sketch_k, index_k=index_k), "sketches")
    # one row stands for its class, whose rows all have the same set; with it the sketch is carried once
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    merged = sketched.where("n_shingles > 0").groupBy("digest").agg(first, *[F.first(c).alias(c) for c in ("n_shingles", "low", "sketch", "mask0", "mask1")])
    merged = scope.saved(merged.select("digest", "first.doc_id", "first.text_key", F.monotonically_increasing_id().alias("node"), "n_shingles", "low", "sketch", "mask0", "mask1"), "merged")
    # by what reads them and for how long: values until they are listed, sketches until links are found
    classes = scope.saved(merged.select("digest", "doc_id", "text_key", "node"), "classes")
    lows = scope.saved(merged.select("node", "low"), "lows")
    spare = F.expr(f"least(n_shingles, {index_k}) - {_overlap('n_shingles', index_k, percent)}").cast("int").alias("spare")
    reps = scope.saved(merged.select("node", "n_shingles", "sketch", spare, "mask0", "mask1"), "representatives")
    sketched = scope.saved(sketched.select("doc_id", "n_shingles", "digest"), "rows")
    scope.drop("sketches", "merged")
    same_row = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["text_key"] == y["text_key"])
    lists = scope.saved(listed_values(lows, scope, index_k=index_k, percent=percent), "lists")
    scope.drop("value-counts", "kept-values", "lows")
    listed = classes.join(lists.select("node").distinct(), "node").select("node", "doc_id", "text_key")
    listed = scope.saved(listed, "listed")
    keyed, n_listed = _keyed(docs), listed.count()
    texts = keyed.join(F.broadcast(listed) if n_listed <= TOLD_NODES else listed, same_row(keyed, listed)).select("node", "text")
    texts = scope.saved(texts, "listed-texts")
    if texts.count() > n_listed:  # the same row stands there more than once
        texts = scope.saved(texts.dropDuplicates(["node"]), "listed-texts")

    deviation = (percent * (100 - percent)) ** 0.5 / 100 / sketch_k**0.5
    cut = percent / 100 - 4 * deviation
    labels = scope.saved(listed.select("node", F.col("node").alias("label")), "labels")
    sized = scope.saved(_of(reps.select("node", *SIZED), labels.select("node")), "sized")
    links = tried = None
    for k in range(star_rounds):
        order = lambda c, k=k: F.xxhash64(F.lit(k), c)
        marked = lists.join(_told(labels, n_listed), "node")
        heads = marked.groupBy("value").agg(F.min(F.struct(order("label").alias("o"), "label", order("node").alias("p"), "node")).alias("head"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        heads = heads.where("lo != hi").select("value", F.col("head.node").alias("b"), F.col("head.label").alias("other"))
        # of the members met, the one in most of a class's lists
        votes = marked.join(heads, "value").where("label != other").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("votes"))
        pairs = scope.saved(votes.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("best")).select("a", F.col("best.b").alias("b")), "voted")
        tried = pairs if tried is None else tried.union(pairs)
        at_a, at_b = (sized.select(F.col("node").alias(c), *_as(c)) for c in "ab")
        alike = scope.saved(pairs.join(_told(at_a, n_listed), "a").join(_told(at_b, n_listed), "b").where(_fitting(percent)).select("a", "b"), "alike")
        guess = estimated(alike, reps, sketch_k).where(F.col("estimate") >= cut)
        found = scope.saved(confirmed(scope.saved(guess.select("a", "b"), "guessed"), texts, shingle_words=shingle_words, percent=percent), "star-links")
        links = found if links is None else links.union(found)
        # a label goes over to the label it was linked to that comes first; as heads come first, no label goes in a circle
        own, other = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
        moves = found.join(own, "a").join(other, "b").groupBy("label_a").agg(F.min(F.struct(order("label_b").alias("o"), "label_b")).alias("to"))
        moves = scope.saved(moves.select(F.col("label_a").alias("label"), F.col("to.label_b").alias("to")), "moves")
        for _ in range(2):  # a label moves once for each node that is listed, at most
            labels = labels.join(_told(moves, n_listed), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = scope.saved(labels, "labels")
    scope.drop("alike", "guessed", "moves")
    crossing = crossing_links(lists, reps, texts, labels, sized, tried, n_listed, scope, shingle_words=shingle_words, percent=percent, sketch_k=sketch_k, cut=cut)
    links = crossing if links is None else links.union(crossing)
    # rows of one document link their classes, each to the first
    named = sketched.where("n_shingles > 0 and doc_id is not null").join(classes.select("digest", "node"), "digest")
    several = named.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b != last").select("doc_id", "b")
    links = scope.saved(links.union(named.join(several, "doc_id").where("node != b").select(F.col("node").alias("a"), "b").distinct()), "links")
    joined = scope.saved(connected_components(links), "components")
    scope.drop("voted", "representatives", "lists", "listed", "listed-texts", "labels", "sized", "mixed", "met", "near", "possible", "star-links", "links")
    members = classes.join(joined, "node", "left").select("digest", "doc_id", F.coalesce("component_id", "node").alias("part"))
    least = members.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(members.join(least, "part").select("digest", "component_id"), "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    whole = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return whole.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is kept, and those without ``doc_id``; of equal rows one."""
    marked = near_duplicates(docs, **options)
    kept = marked.where("kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    # whole rows travel in one column, so no name of theirs can clash
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"))
    named = rows.join(kept, "id", "left_semi").dropDuplicates(["id", "text_key"])
    return named.select("doc.*").union(rows.where("id is null").select("doc.*"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2, percent=80)
