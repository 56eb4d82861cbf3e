"""Line de-duplication by a segment-partition edit join, in DataFrame and SQL functions only.

Lines are numbered in the order of (doc_id, line). A line goes if an earlier line equals it, or if
both have ``min_chars`` characters or more and the earlier lies within ``max_edits`` edits. All
lines are judged on the input. Blank lines always stay. With ``word_edits`` a line of ``MIN_WORDS``
words or more also goes if an earlier one differs from it by so many replaced, added or dropped words.

* Equal lines are one digest with their first place; whatever is no first place goes.
* Each different line is split into ``max_edits + 1`` segments. Within so many edits of another line it
  keeps one of that line's segments unedited, near the place where it stood: for each length a partner
  may have and each segment, only the few start places are probed that leave enough edits for both
  sides (multi-match-aware windows). Keys are hashes of length, segment number and segment.
* Lines that share a key are paired where the key has ``HOT_LINES`` lines at most, so a line has a few pairs for
  each of its keys. With one edit, a hotter key is split: what the shared segment leaves of the line is cut in
  two again, one part of which must also be shared, and so on until a key is shared by few lines or ``LEAF`` units
  are left. There a line goes to the key of each string that it becomes with one unit left out; lines of equal length
  that meet with the same place left out are all within one edit of one another, so each is paired with
  the first alone. No step makes all pairs of a hot key, and none drops a pair that decides a line.
* Only the texts of lines that share a key are fetched, once. Pairs are stripped of their common prefix and suffix and
  verified by a banded bit-parallel distance: for each number of errors, one bit for each diagonal of
  the band, all moved at once.

Defined results: null texts count as empty and keep their one blank line; rows without a ``doc_id`` come first,
by 94 bits of hashes of their text; rows that share a ``doc_id`` follow one another by a hash of their text below
10**9, so two of them may be taken for one where tens of thousands share one id; fully equal rows count as one place; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.storage import saved

MAX_EDITS = 1
MIN_CHARS = 40
#: Lines of fewer words are near by characters only.
MIN_WORDS = 8
#: A key is split no further where the partner's line has no more units left.
LEAF = 8
#: A key of more lines is split further before lines are paired: from there on a line has more partners than strings in a leaf.
HOT_LINES = 8
#: So many documents' numbers are broadcast at most, 24 bytes each.
TOLD_HOMES = 500_000
_NO_ID = Decimal(-(1 << 64) - 1)
_LINES = 10**9


@dataclass(frozen=True)
class Units:
    """What an edit changes: how lines are cut, measured and sliced (from 1)."""

    cut: Callable[[Column], Column]
    size: Callable[[Column], Column]
    part: Callable[[Column, Column, Column], Column]
    join: Callable[[Column, Column], Column]


CHARACTERS = Units(lambda line: line, F.length, lambda seq, start, n: F.substring(seq, start, n), F.concat)
WORDS = Units(lambda line: F.split(F.trim(line), r"\s+"), F.size, lambda seq, start, n: F.slice(seq, start, n), F.concat)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def segment_bounds(length: Column, segments: int) -> list[tuple[Column, Column]]:
    """(start from 1, length) of each segment of a line; later segments take the remainder."""
    small = F.floor(length / segments).cast("int")
    longer = length - small * segments  # so many segments at the end have one unit more
    bounds, start = [], F.lit(1)
    for k in range(segments):
        size = small + F.when(F.lit(segments - k) <= longer, 1).otherwise(0)
        bounds.append((start, size))
        start = start + size
    return bounds


def segment_keys(seq: Column, size: Column, max_edits: int, units: Units = CHARACTERS) -> list[tuple[bool, int, Column]]:
    """(held, gap, key): a line finds those that hold the key and are shorter by ``gap`` units.

    Keys that a line holds are its own segments, which it also asks for with a gap of none.
    """
    keys = []
    for gap in range(max_edits + 1):
        partner = size - gap
        for k, (start, length) in enumerate(segment_bounds(partner, max_edits + 1)):
            lowest = max(-k, gap - (max_edits - k))
            highest = min(k, gap + (max_edits - k))
            for shift in range(lowest, highest + 1):
                keys.append((gap == 0 and shift == 0, gap, F.xxhash64(partner.cast("int"), F.lit(k), units.part(seq, start + shift, length))))
    return keys


def _common(a: Column, b: Column, from_end: bool, units: Units) -> Column:
    """Length of the common prefix or suffix, found by halving steps."""

    def same(n: Column) -> Column:
        if from_end:
            return units.part(a, units.size(a) - n + 1, n) == units.part(b, units.size(b) - n + 1, n)
        return units.part(a, F.lit(1), n) == units.part(b, F.lit(1), n)

    steps = F.transform(F.sequence(F.lit(24), F.lit(0)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    most = F.least(units.size(a), units.size(b))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(n + step > most, n).when(same(n + step), n + step).otherwise(n))


def within_edits(a: Column, b: Column, max_edits: int, units: Units = CHARACTERS) -> Column:
    """Banded bit-parallel test of an edit distance of ``max_edits`` at most.

    Bit ``d + max_edits`` of row e is set when, after j units of ``b``, the first j + d units
    of ``a`` are matched with e errors at most.
    """
    width = 2 * max_edits + 1
    band = (1 << width) - 1
    first = [1 << max_edits]
    for _ in range(max_edits):
        first.append((first[-1] | first[-1] << 1) & band)
    at = lambda seq, k: units.part(seq, k, F.lit(1))

    def step(rows: Column, j: Column) -> Column:
        match = reduce(
            lambda x, y: x.bitwiseOR(y),
            # places before the first unit have nothing to match
            [F.when((j + d >= 1) & (j + d <= units.size(a)) & (at(a, F.greatest(j + d, F.lit(1))) == at(b, j)), F.lit(1 << (d + max_edits))).otherwise(F.lit(0)) for d in range(-max_edits, max_edits + 1)],
        )
        now = [F.element_at(rows, 1).bitwiseAND(match)]
        for e in range(1, max_edits + 1):
            before = F.element_at(rows, e)
            same = F.element_at(rows, e + 1).bitwiseAND(match)
            edited = before.bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(now[-1], 1).bitwiseAND(F.lit(band)))
            now.append(same.bitwiseOR(edited))
        return F.array(*now)

    start = F.array(*[F.lit(x) for x in first])
    places = F.when(units.size(b) > 0, F.sequence(F.lit(1), units.size(b))).otherwise(F.array().cast("array<int>"))
    last = units.size(a) - units.size(b) + max_edits
    reached = F.element_at(F.aggregate(places, start, step), max_edits + 1)
    return (last >= 0) & (last < width) & (F.pmod(F.floor(reached / F.pow(F.lit(2.0), F.greatest(last, F.lit(0)))), F.lit(2)) == 1)


def near(a: Column, b: Column, max_edits: int, units: Units = CHARACTERS) -> Column:
    """Are two lines within ``max_edits`` edits? Common ends are taken off before the distance is."""

    def inside(r: Column) -> Column:
        if max_edits == 1:  # what differs is one unit on either side
            return F.when((units.size(r["a"]) <= 1) & (units.size(r["b"]) <= 1), within_edits(r["a"], r["b"], max_edits, units)).otherwise(F.lit(False))
        return within_edits(r["a"], r["b"], max_edits, units)

    def without_tail(q: Column) -> Column:
        cut = lambda seq, tail: units.part(seq, F.lit(1), units.size(seq) - tail)
        return _let(_common(q["a"], q["b"], True, units), lambda tail: _let(F.struct(cut(q["a"], tail).alias("a"), cut(q["b"], tail).alias("b")), inside))

    def without_head(p: Column) -> Column:
        cut = lambda seq, head: units.part(seq, head + 1, F.greatest(units.size(seq) - head, F.lit(0)))
        return _let(_common(p["a"], p["b"], False, units), lambda head: _let(F.struct(cut(p["a"], head).alias("a"), cut(p["b"], head).alias("b")), without_tail))

    return _let(F.struct(units.cut(a).alias("a"), units.cut(b).alias("b")), without_head)


def _paired(entries: DataFrame) -> DataFrame:
    """(place, other) of ``entries(key, place, held, gap)`` where one holds the key and the other asks for it."""
    x, y = entries.where("held").alias("x"), entries.alias("y")
    met = x.join(y, F.col("x.key") == F.col("y.key")).where("y.gap > 0 or x.place < y.place or (x.place > y.place and not y.held)")
    return met.select(F.col("x.place").alias("place"), F.col("y.place").alias("other"))


def _by_heat(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries whose key others share: of keys with few lines, and of hot ones."""
    counts = entries.groupBy("key").agg(F.count("*").alias("lines"), F.max("held").alias("any_held")).where("lines > 1 and any_held").select("key", "lines")
    shared = saved(entries.join(counts, "key"), "shared-segments")
    return shared.where(F.col("lines") <= HOT_LINES).drop("lines"), shared.where(F.col("lines") > HOT_LINES).drop("lines")


def _split_hot(hot: DataFrame, texts: DataFrame, units: Units) -> DataFrame:
    """Pairs (place, other) of hot keys' ``entries``, for one edit; see the module's text."""
    size, left = units.size(F.col("seq")), F.col("size") - F.col("gap") - F.col("lo") - F.col("hi")
    rest = hot.join(texts.select("place", units.cut(F.col("line")).alias("seq")), "place").withColumn("size", size)
    # the segment that is shared: the first or the last half of the partner's line
    half = F.floor((F.col("size") - F.col("gap")) / 2).cast("int")
    rest = rest.withColumn("lo", F.when(F.col("side") == 0, half).otherwise(0)).withColumn("hi", F.when(F.col("side") == 1, F.col("size") - F.col("gap") - half).otherwise(0)).drop("side")
    pairs = None
    while not rest.isEmpty():
        rest = rest.withColumn("left", left)
        leaves = _leaf_pairs(rest.where(F.col("left") <= LEAF), units)
        pairs = leaves if pairs is None else pairs.union(leaves)
        deeper = rest.where(F.col("left") > LEAF)
        for _ in range(2):  # two cuts at a time
            head = F.floor(F.col("left") / 2).cast("int")
            tail = F.col("left") - head
            first = F.struct(F.xxhash64("key", F.lit(0), units.part(F.col("seq"), F.col("lo") + 1, head)).alias("key"), (F.col("lo") + head).alias("lo"), F.col("hi").alias("hi"))
            second = F.struct(F.xxhash64("key", F.lit(1), units.part(F.col("seq"), F.col("size") - F.col("hi") - tail + 1, tail)).alias("key"), F.col("lo").alias("lo"), (F.col("hi") + tail).alias("hi"))
            deeper = deeper.select("place", "held", "gap", "seq", "size", F.explode(F.array(first, second)).alias("to")).select("place", "held", "gap", "seq", "size", "to.*").withColumn("left", left)
        few, rest = _by_heat(deeper.drop("left"))
        pairs = pairs.union(_paired(few))
    return hot.select("place", F.col("place").alias("other")).limit(0) if pairs is None else pairs


def _leaf_pairs(leaves: DataFrame, units: Units) -> DataFrame:
    """Pairs among lines that share all but ``left`` units: by the strings left when one unit is left out."""
    rest = units.part(F.col("seq"), F.col("lo") + 1, F.col("left") + F.col("gap"))
    lines = leaves.select("key", "place", "held", "gap", rest.alias("rest"), (F.col("left") + F.col("gap")).alias("n"))

    def without(k: Column) -> Column:
        return units.join(units.part(F.col("rest"), F.lit(1), k - 1), units.part(F.col("rest"), k + 1, F.col("n") - k))

    places = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    shorter = lines.withColumn("k", F.explode(places))
    # equal lengths: the place left out is part of the key
    replaced = shorter.where("gap = 0").select(F.xxhash64("key", "k", without(F.col("k"))).alias("key"), "place")
    first = replaced.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("lines")).where("lines > 1").select("key", "first")
    pairs = replaced.join(first, "key").where("place != first").select(F.col("first").alias("place"), F.col("place").alias("other"))
    # one longer: a whole rest is one line, so each longer line meets one
    whole = lines.where("gap = 0").select(F.xxhash64("key", "rest").alias("key"), "place")
    dropped = shorter.where("gap = 1").select(F.xxhash64("key", without(F.col("k"))).alias("key"), F.col("place").alias("other"))
    return pairs.union(whole.join(dropped, "key").select("place", "other"))


def near_lines(keyed: DataFrame, texts_of: Callable[[DataFrame], DataFrame], *, max_edits: int, units: Units = CHARACTERS) -> DataFrame:
    """Pairs (place, other) of different lines within ``max_edits`` edits.

    ``keyed(place, keys...)`` has the lines' segment keys in the order of ``segment_keys``, null for lines
    that are too short; ``texts_of`` adds ``line`` to a table of places.
    """
    kinds = segment_keys(F.lit(""), F.lit(0), max_edits) if units is CHARACTERS else segment_keys(F.array(F.lit("")), F.lit(0), max_edits, units)
    names = [c for c in keyed.columns if c != "place"]
    rows = [F.struct(F.col(c).alias("key"), F.lit(held).alias("held"), F.lit(gap).alias("gap"), F.lit(k % 2).alias("side")) for k, (c, (held, gap, _)) in enumerate(zip(names, kinds, strict=True))]
    entries = keyed.where(F.col(names[0]).isNotNull()).select("place", F.explode(F.array(*rows)).alias("e")).select("place", "e.*").where("key is not null")
    few, hot = _by_heat(entries)
    texts = saved(texts_of(few.select("place").union(hot.select("place")).distinct()), "shared-lines")
    pairs = _paired(few)
    if max_edits == 1 and not hot.isEmpty():
        pairs = pairs.union(_split_hot(hot, texts, units))
    elif max_edits > 1:  # the join deals hot keys to several tasks
        pairs = pairs.union(_paired(hot))
    pairs = saved(pairs.distinct(), "line-pairs")
    both = pairs.join(texts.withColumnRenamed("line", "a"), "place").join(texts.select(F.col("place").alias("other"), F.col("line").alias("b")), "other")
    return both.where(near(F.col("a"), F.col("b"), max_edits, units)).select("place", "other")


def dedup_lines(docs: DataFrame, *, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, word_edits: int = 0, counts: bool = True) -> DataFrame:
    """The rows of ``docs`` with ``text`` cut to the lines that stay, and with ``counts`` n_lines, n_exact and n_near in place of such columns."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    # (doc_id, hash of the text, line number) as one number, so that places compare and aggregate as one; without a
    # doc_id a whole hash stands in its place, below all of them
    unnamed = F.lit(_NO_ID).cast("decimal(21,0)") - F.xxhash64("text").cast("decimal(20,0)")
    own = F.when(F.col("doc_id").isNotNull(), F.col("doc_id").cast("decimal(21,0)")).otherwise(unnamed.cast("decimal(21,0)"))
    home = (own * F.lit(_LINES).cast("decimal(10,0)") + F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(_LINES)).cast("decimal(10,0)")).cast("decimal(29,0)")
    # whole rows travel in one column, so no name of theirs can clash
    homes = docs.select(F.struct("*").alias("_doc"), "text", home.alias("_home"))
    each = homes.select("_home", F.posexplode(lines).alias("number", "line")).where(F.trim("line") != "")
    place = (F.col("_home") * F.lit(_LINES).cast("decimal(10,0)") + F.col("number").cast("decimal(10,0)")).cast("decimal(38,0)")
    searches = [(CHARACTERS, max_edits, min_chars, "c")] + ([(WORDS, word_edits, MIN_WORDS, "w")] if word_edits else [])
    keys, names = [], {}
    for units, edits, least, letter in searches:
        seq = units.cut(F.col("line"))
        size = units.size(seq)
        own = [F.when(size - gap >= least, key).alias(f"{letter}{k}") for k, (_, gap, key) in enumerate(segment_keys(seq, size, edits, units))]
        keys, names[letter] = keys + own, [f"{letter}{k}" for k in range(len(own))]
    digest = F.substring(F.unhex(F.sha2("line", 256)), 1, 16)
    # equal lines have equal keys, so any of them will do
    occurrences = each.select(digest.alias("digest"), place.alias("place"), *keys)
    every = [n for own in names.values() for n in own]
    first = saved(occurrences.groupBy("digest").agg(F.min("place").alias("place"), *[F.min(n).alias(n) for n in every]).drop("digest"), "first-lines")

    number = F.pmod("place", F.lit(_LINES).cast("decimal(38,0)"))
    home_of = ((F.col("place") - number) / F.lit(_LINES).cast("decimal(10,0)")).cast("decimal(29,0)")

    def texts_of(places: DataFrame) -> DataFrame:
        # no more numbers than the document has lines
        wanted = places.groupBy(home_of.alias("_home")).agg(F.collect_list(F.struct(number.cast("int").alias("number"), "place")).alias("wanted"))
        documents = homes.select("_home", "text")
        # only what is wanted is shuffled, where the homes of it are few enough to be told to all tasks
        if wanted.count() <= TOLD_HOMES:
            documents = documents.join(F.broadcast(wanted.select("_home")), "_home", "left_semi")
        found = documents.join(wanted, "_home").select(lines.alias("lines"), F.explode("wanted").alias("at"))
        return found.select("at.place", F.element_at("lines", F.col("at.number") + 1).alias("line")).dropDuplicates(["place"])

    pairs = None
    for units, edits, _, letter in searches:
        more = near_lines(first.select("place", *names[letter]), texts_of, max_edits=edits, units=units)
        pairs = more if pairs is None else pairs.union(more)
    late = saved(pairs.select(F.greatest("place", "other").alias("place")).distinct(), "late-lines").withColumn("near", F.lit(1))
    told = first.select("place").join(late, "place", "left").select(home_of.alias("_home"), number.cast("int").alias("number"), "near")
    told = told.groupBy("_home").agg(F.collect_list(F.when(F.col("near").isNull(), F.col("number"))).alias("_kept"), F.count("near").alias("n_near"))
    out = homes.join(told, "_home", "left").withColumn("_lines", lines)
    blank = F.filter(F.transform("_lines", lambda x, k: F.when(F.trim(x) == "", k)), lambda k: k.isNotNull())
    out = out.withColumn("_blank", blank).withColumn("_kept", F.coalesce("_kept", F.array().cast("array<int>")))
    stay = F.transform(F.array_sort(F.array_union("_blank", "_kept")), lambda k: F.element_at("_lines", k + 1))
    out = out.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))
    out = out.withColumn("n_exact", F.col("n_lines") - F.size("_blank") - F.size("_kept") - F.col("n_near"))
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.array_join(stay, "\n")))
    more = ["n_lines", "n_exact", "n_near"] if counts else []
    return out.select(*[F.col("text") if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in more], *more)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents
), filled AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, n) AS place FROM lines WHERE trim(line, ' ') <> ''
), firsts AS (
  SELECT line, min(place) AS place, length(line) AS size FROM filled GROUP BY line
), long_lines AS (
  SELECT *, left(line, (size - 1) // 2) AS head, right(line, (size - 1) // 2) AS tail,
         left(line, (size - 2) // 2) AS head1, right(line, (size - 2) // 2) AS tail1
  FROM firsts WHERE size >= {MIN_CHARS}
), candidates AS (
  SELECT a.line AS a, b.line AS b, a.place AS pa, b.place AS pb FROM long_lines a JOIN long_lines b ON a.size = b.size AND a.head = b.head AND a.place < b.place
  UNION SELECT a.line, b.line, a.place, b.place FROM long_lines a JOIN long_lines b ON a.size = b.size AND a.tail = b.tail AND a.place < b.place
  UNION SELECT a.line, b.line, a.place, b.place FROM long_lines a JOIN long_lines b ON a.size + 1 = b.size AND a.head = b.head1
  UNION SELECT a.line, b.line, a.place, b.place FROM long_lines a JOIN long_lines b ON a.size + 1 = b.size AND a.tail = b.tail1
), pairs AS (
  SELECT pa, pb FROM candidates
  WHERE len(list_filter(range(0, length(b)), lambda i: left(a, i) = left(b, i) AND right(a, length(b) - i - 1) = right(b, length(b) - i - 1))) > 0
), late AS (
  SELECT DISTINCT greatest(pa, pb) AS place FROM pairs
), told AS (
  SELECT l.doc_id, l.n, l.line, f.place IS NOT NULL AS filled, f.place = s.place AS is_first, t.place IS NOT NULL AS is_late
  FROM lines l LEFT JOIN filled f ON l.doc_id = f.doc_id AND l.n = f.n LEFT JOIN firsts s ON f.line = s.line LEFT JOIN late t ON f.place = t.place
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (filled AND NOT is_first) AS BIGINT) AS n_exact,
       CAST(count(*) FILTER (filled AND is_first AND is_late) AS BIGINT) AS n_near,
       CAST(length(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT filled OR (is_first AND NOT is_late)), '')) AS BIGINT) AS kept_chars,
       md5(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT filled OR (is_first AND NOT is_late)), '')) AS kept_md5
FROM told GROUP BY doc_id
"""
