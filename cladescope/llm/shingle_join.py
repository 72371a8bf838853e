"""Similarity join of documents on five-word shingles, by rare-first prefix filtering.

A document's set holds the hashes of its distinct shingles. Two sets reach a
Jaccard similarity of 0.8 only if they share a shingle among their first
n - ceil(0.8 n) + 1 in one common order of all shingles; the order puts frequent
shingles last. Postings of those prefixes meet by shingle; the length and
positional filters cut pairs there, the suffix filter (parities of the counts in
512 ranges of the hash, of which sets can't differ more often than in shingles)
cuts them before any set is moved, and each remaining pair is verified once on
the whole sets.

No bucket's pairs are all emitted. Equal sets collapse into a class first.
Shingles that only one class holds in its prefix go, and the positional filter
counts without them, which leaves texts that differ by much out of their group's
buckets. In each of a few rounds a bucket's postings meet one pivot, unless they
are of its component already; verified links give components. The last round
takes the pairs in a bucket whose members still lie in different components,
which is exactly what can still connect anything. A large group of near copies so
costs a few pairs a member, and nothing is dropped.

Scale: postings of prefixes (a fifth of the shingles) are the one large shuffle;
the sorted buckets are streamed. The buckets that are left, a few hundredths, move
twice more by shingle: for the pivots of all rounds, and for the largest components
in the last round (windows, which spill). Frequent shingles are counted
in a bounded table (FREQUENT rows); any order gives the same result, so its
bound touches speed only. Sets move only for documents in surviving pairs: a
bit map of fixed size sieves one row a class at the scan. A written table goes when
its last reader is done.

Hashes: 48 bits a shingle, 63 bits a class. Components need no more than the
links, but the number of links of a class to others is not counted.

Defined cases: a text without words (or null) has an empty set and is linked with
nothing; under five words the whole sequence is the one shingle; repeated rows
have equal sets and form one group; a null doc_id takes part but never names a
component unless all its members' ids are null (then null); empty tables give
empty results; extra columns are ignored, and carried by ``keep_one``.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladescope.llm.common import discard, lean, materialize
from cladescope.llm.textscan import mix, odd_numbers, scan_words, slices
from cladescope.operators.graph import contract

WORDS, PERCENT = 5, 80
#: Rounds with a pivot before the exact one.
ROUNDS = 3
#: Rows of the table of frequent shingles, and shingles counted together in search of them.
FREQUENT, COUNTED = 400_000, 1 << 23
#: Ranges of the hash whose parities the suffix filter compares (multiples of 64): in joins, and on the pairs that these leave; bits of the sieve.
RANGES, MORE_RANGES, SIEVE_BITS = 512, 2048, 1 << 25
_PLACE = odd_numbers(6, WORDS)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Per text the sorted distinct 48-bit hashes of its shingles."""
    found = scan_words(texts, lower=True)
    word, first = found.hashes, found.first
    n = len(word)
    whole = np.zeros(max(n - WORDS + 1, 0), np.uint64)
    for k, m in enumerate(_PLACE):
        whole += word[k : k + len(whole)] * m
    whole = mix(whole) >> np.uint64(16)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(whole[a : b - WORDS + 1]))
        elif b > a:
            few = (word[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)
            out.append(mix(few) >> np.uint64(16))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _pack(s: np.ndarray) -> bytes:
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def _class_of(packed: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little") >> 1


def _parities(s: np.ndarray, ranges: int) -> np.ndarray:
    """Whether the set's count is odd in each of so many parts of the hash, as 64-bit numbers."""
    odd = np.bincount((s & np.uint64(ranges - 1)).astype(np.int64), minlength=ranges) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def least_overlap(n):
    """Fewest common shingles of a set of n with any partner."""
    return (PERCENT * n + 99) // 100


def document_sets(docs: DataFrame) -> DataFrame:
    """Per row: row (a number), doc_id, thash (of the text), n, cls (null if empty), odd, wide, packed; written to the shared folder."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in slices(texts):
                sets = shingle_sets(texts[begin:end])
                packed = [_pack(s) for s in sets]
                cut = batch.slice(begin, end - begin)
                yield pa.record_batch(
                    [cut.column("row"), cut.column("doc_id"), cut.column("thash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(p) if p else None for p in packed], pa.int64()), pa.array([_parities(s, RANGES) for s in sets], pa.list_(pa.int64())), pa.array([_parities(s, MORE_RANGES).tobytes() for s in sets], pa.binary()), pa.array(packed, pa.binary())],
                    names=["row", "doc_id", "thash", "n", "cls", "odd", "wide", "packed"],
                )

    slim = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("thash"), docs["text"].alias("text"))
    return materialize(slim.mapInArrow(lean(run), "row long, doc_id long, thash long, n long, cls long, odd array<long>, wide binary, packed binary"), "shingles")


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur within COUNTED neighbouring ones, and how often they were seen; FREQUENT at most."""

    def run(batches):
        held, size = np.empty(COUNTED, np.uint64), 0  # one buffer, sorted in place

        def found(s):
            s.sort()
            # only runs of equal ones are looked at: the others take no places of their own
            edge = np.diff(np.concatenate([[False], s[1:] == s[:-1], [False]]).astype(np.int8))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            return pa.record_batch([pa.array(s[begin].astype(np.int64)), pa.array(end - begin + 1)], names=["shingle", "seen"])

        for batch in batches:
            for b in batch.column("packed"):
                own = _unpack(b.as_py())
                if size + len(own) > COUNTED and size:
                    yield found(held[:size])
                    size = 0
                if len(own) <= COUNTED:  # a set alone has no shingle twice
                    held[size : size + len(own)] = own
                    size += len(own)
        if size:
            yield found(held[:size])

    seen = sets.select("packed").mapInArrow(lean(run), "shingle long, seen long").groupBy("shingle").agg(F.sum("seen").alias("seen"))
    table = seen.where("seen > 4").orderBy(F.desc("seen"), "shingle").limit(FREQUENT).toArrow()
    shingle, n = table["shingle"].to_numpy().astype(np.uint64), table["seen"].to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def prefix(s: np.ndarray, frequent: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The set's prefix in the common order: rare first, then by hash."""
    size = len(s) - int(least_overlap(len(s))) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        weight = np.where(frequent[at] == s, seen[at], 0)
        if weight.any():
            s = s[np.lexsort((s, weight))]
    return s[:size]


def _postings(sets: DataFrame) -> DataFrame:
    """shingle, cls, n, pos of every class's prefix; a class once a task."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent_shingles(sets))

    def run(batches):
        frequent, seen = shared.value
        known: set[int] = set()
        for batch in batches:
            shingles, owners, sizes = [], [], []
            for cls, packed in zip(batch.column("cls").to_pylist(), batch.column("packed").to_pylist()):
                if cls is None or cls in known:
                    continue
                known.add(cls)
                s = _unpack(packed)
                shingles.append(prefix(s, frequent, seen))
                owners.append(cls)
                sizes.append(len(s))
            if not shingles:
                continue
            length = [len(x) for x in shingles]
            yield pa.record_batch(
                [
                    pa.array(np.concatenate(shingles).astype(np.int64)),
                    pa.array(np.repeat(np.array(owners, np.int64), length)),
                    pa.array(np.repeat(np.array(sizes, np.int32), length)),
                    pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in length])),
                ],
                names=["shingle", "cls", "n", "pos"],
            )

    return sets.select("cls", "packed").mapInArrow(lean(run), "shingle long, cls long, n int, pos int")


class BucketStream:
    """Passes on postings, sorted by shingle, n and class, of shingles with more than one class.

    A class counts once a bucket. Only the last posting is kept between batches,
    and whether it was passed on.
    """

    def __init__(self):
        self.last = np.zeros((0, 4), np.int64)
        self.passed = False

    def take(self, rows: np.ndarray) -> np.ndarray:
        """rows: shingle, cls, n, pos."""
        before = len(self.last)
        rows = np.concatenate([self.last, rows])
        same = np.concatenate([[False], (rows[1:, :2] == rows[:-1, :2]).all(1)])
        rows = rows[~same]
        twin = rows[1:, 0] == rows[:-1, 0]
        keep = np.concatenate([[False], twin]) | np.concatenate([twin, [False]])
        if before:
            keep[0], passed = keep[0] and not self.passed, self.passed
        # the last one follows when its next is known to share the shingle
        self.passed = bool(keep[-1]) or bool(before and len(rows) == 1 and passed)
        self.last = rows[-1:]
        return rows[keep]


def may_reach(n1, p1, k1, n2, p2, k2):
    """Length filter, and positional filter for a common shingle (numbers, arrays or columns).

    It lies at positions p1 and p2; k1 and k2 of the shingles before it are held by
    other classes too. Common shingles are among those, or it, or after both.
    """
    smaller = F.least if isinstance(n1, Column) else np.minimum
    most = smaller(k1, k2) + 1 + smaller(n1 - p1 - 1, n2 - p2 - 1)
    return (100 * n1 >= PERCENT * n2) & (100 * n2 >= PERCENT * n1) & ((100 + PERCENT) * most >= PERCENT * (n1 + n2))


def _buckets(postings: DataFrame) -> DataFrame:
    """shingle, cls, n, pos, k: postings of shingles with several classes; k of the class's postings come before."""
    spark = postings.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = postings.repartition(parts, "shingle").sortWithinPartitions("shingle", "n", "cls")
    names = ["shingle", "cls", "n", "pos"]

    def run(batches):
        stream = BucketStream()
        held, size = [], 0

        def flush():
            rows = stream.take(np.concatenate(held))
            return pa.record_batch([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3].astype(np.int32))], names=names)

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names], 1))
            size += len(held[-1])
            if size >= 1 << 18:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    shared = materialize(dealt.mapInArrow(lean(run), "shingle long, cls long, n int, pos int"), "shared")
    k = F.row_number().over(Window.partitionBy("cls").orderBy("pos")) - 1
    buckets = materialize(shared.withColumn("k", k), "buckets")
    discard(shared)
    return buckets


def _sieve(ids: DataFrame) -> np.ndarray:
    """Bit map of fixed size with the bits of ``ids`` (id) set."""
    bit = F.pmod(F.xxhash64("id"), F.lit(SIEVE_BITS))
    words = ids.groupBy((F.floor(bit / 32)).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(SIEVE_BITS // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def _column_of(sets: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """row and the binary ``column`` of the rows in ``pairs`` (and a few others), written."""
    ids = pairs.select(F.col("row_x").alias("id")).unionByName(pairs.select(F.col("row_y").alias("id")))
    shared = sets.sparkSession.sparkContext.broadcast(_sieve(ids))

    def run(batches):
        sieve = shared.value
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            hit = np.flatnonzero(sieve[bit // 32] >> (bit % 32).astype(np.uint32) & 1)
            yield pa.record_batch([batch.column("row"), batch.column(column)], names=["row", column]).take(pa.array(hit))

    bit = F.pmod(F.xxhash64("row"), F.lit(SIEVE_BITS)).cast("int").alias("bit")
    return materialize(sets.where("cls is not null").select("row", column, bit).mapInArrow(lean(run), f"row long, {column} binary"), "paired")


def _known(sets: DataFrame) -> DataFrame:
    """cls, n, odd and one row of every class."""
    return sets.where("cls is not null").select("cls", "n", "odd", "row").dropDuplicates(["cls"])


def may_equal(n1: Column, odd1: Column, n2: Column, odd2: Column) -> Column:
    """Length and suffix filter: as many ranges of odd counts differ as shingles do, at most."""
    apart = [F.bit_count(odd1[i].bitwiseXOR(odd2[i])) for i in range(RANGES // 64)]
    return (100 * n1 >= PERCENT * n2) & (100 * n2 >= PERCENT * n1) & ((100 + PERCENT) * sum(apart[1:], apart[0]) <= (100 - PERCENT) * (n1 + n2))


_PAIR = ["x", "y", "row_x", "row_y"]


def _links(sets: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (x, y) of classes that reach the similarity; each is verified once.

    Sets move for the pairs only that the suffix filter leaves, with more ranges at last.
    """
    class_of = lambda of: known.select(F.col("cls").alias(of), *[F.col(c).alias(f"{c}_{of}") for c in ("n", "odd", "row")])
    with_rows = lambda some, table, c: functools.reduce(lambda left, of: left.join(table.select(F.col("row").alias(f"row_{of}"), F.col(c).alias(f"{c}_{of}")), f"row_{of}"), "xy", some)
    near = pairs.join(class_of("x"), "x").join(class_of("y"), "y")
    near = materialize(near.where(may_equal(F.col("n_x"), F.col("odd_x"), F.col("n_y"), F.col("odd_y"))).select(*_PAIR, (F.col("n_x") + F.col("n_y")).alias("n")), "near")
    wide = _column_of(sets, near, "wide")

    def sift(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(f"wide_{c}").to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in "xy")
            apart = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
            keep = (100 + PERCENT) * apart <= (100 - PERCENT) * batch.column("n").to_numpy()
            yield pa.record_batch([batch.column(c) for c in _PAIR], names=_PAIR).filter(pa.array(keep, pa.bool_()))

    close = materialize(with_rows(near, wide, "wide").mapInArrow(lean(sift), ", ".join(f"{c} long" for c in _PAIR)), "close")
    discard(near, wide)
    kept = _column_of(sets, close, "packed")

    def verify(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("packed_x"), batch.column("packed_y")):
                p, q = _unpack(a.as_py()), _unpack(b.as_py())
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(p) + len(q) - common))
            yield pa.record_batch([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    links = materialize(with_rows(close, kept, "packed").mapInArrow(lean(verify), "x long, y long"), "links")
    discard(close, kept)
    return links


def _others(buckets: DataFrame, component: DataFrame | None) -> DataFrame:
    """The postings outside main, the largest component of their bucket, with comp and main.

    Before there are components every posting has its own, and there is no largest one.
    """
    if component is None:
        return buckets.withColumns({"comp": F.col("cls"), "main": F.lit(None).cast("long")})
    rows = buckets.join(component, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cls")).drop("node", "component")
    # dealt by shingle once, which serves both windows
    rows = rows.repartition("shingle").withColumn("size", F.count("*").over(Window.partitionBy("shingle", "comp")))
    return rows.withColumn("main", F.max(F.struct("size", "comp")).over(Window.partitionBy("shingle"))["comp"]).where("comp != main").drop("size")


_PLACES = ("cls", "n", "pos", "k", "comp")


def _reach(x: str, y: str) -> Column:
    return may_reach(*[F.col(f"{c}_{x}") for c in ("n", "pos", "k")], *[F.col(f"{c}_{y}") for c in ("n", "pos", "k")])


def _side(rows: DataFrame, of: str, *more: Column) -> DataFrame:
    return rows.select("shingle", *[F.col(c).alias(f"{c}_{of}") for c in _PLACES], *more)


def _pivot_pairs(buckets: DataFrame) -> DataFrame:
    """x, y, turn: every posting with its bucket's pivots; a pair once, in its first turn.

    A pivot is the class of the least hash of a bucket: buckets with much the same
    classes have the same pivot, and another one each turn.
    """
    places = _PLACES[:-1]
    pivot = lambda turn: F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), F.lit(turn).alias("turn"), *places)).over(Window.partitionBy("shingle"))
    met = buckets.select(*[F.col(c).alias(f"{c}_x") for c in places], F.array(*map(pivot, range(ROUNDS))).alias("pivots"))
    met = met.withColumn("p", F.explode("pivots")).select(*[f"{c}_x" for c in places], F.col("p.turn").alias("turn"), *[F.col(f"p.{c}").alias(f"{c}_y") for c in places])
    met = met.where((F.col("cls_x") != F.col("cls_y")) & _reach("x", "y"))
    return met.groupBy(F.least("cls_x", "cls_y").alias("x"), F.greatest("cls_x", "cls_y").alias("y")).agg(F.min("turn").alias("turn"))


def _apart(pairs: DataFrame, component: DataFrame | None) -> DataFrame:
    """The pairs (x, y) whose classes are in different components so far."""
    if component is None:
        return pairs
    for c in "xy":
        pairs = pairs.join(component.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
    return pairs.where(F.coalesce("of_x", "x") != F.coalesce("of_y", "y")).select("x", "y")


def _remaining_pairs(others: DataFrame, component: DataFrame | None, known: DataFrame) -> DataFrame:
    """All pairs of a bucket in different components that pass the filters.

    A member of a bucket's largest component meets the bucket's others as a member
    of that component, once and not once a shingle; the others meet by shingle.
    The suffix filter is part of both joins.
    """
    members = known.select(F.col("cls").alias("main"), "cls", "n", "odd") if component is None else known.join(component, F.col("cls") == F.col("node"), "left").withColumn("main", F.coalesce("component", "cls"))
    members = members.select("main", F.col("cls").alias("cls_x"), F.col("n").alias("n_x"), F.col("odd").alias("odd_x"))
    apart = others.select("main", F.col("cls").alias("cls_y")).distinct().join(known.select(F.col("cls").alias("cls_y"), F.col("n").alias("n_y"), F.col("odd").alias("odd_y")), "cls_y")
    equal = may_equal(F.col("n_x"), F.col("odd_x"), F.col("n_y"), F.col("odd_y"))
    first = apart.join(members, "main").where(equal & (F.col("cls_x") != F.col("cls_y")))
    # a bucket with one other member has no such pair
    several = others.groupBy("shingle").agg(F.countDistinct("comp").alias("c")).where("c > 1").select("shingle")
    rest = others.join(several, "shingle", "left_semi").join(known.select("cls", "odd"), "cls")
    met = _side(rest, "x", F.col("odd").alias("odd_x")).join(_side(rest, "y", F.col("odd").alias("odd_y")), "shingle")
    second = met.where((F.col("comp_x") != F.col("comp_y")) & (F.col("cls_x") < F.col("cls_y")) & _reach("x", "y") & equal)
    return first.select("cls_x", "cls_y").unionByName(second.select("cls_x", "cls_y")).select(F.least("cls_x", "cls_y").alias("x"), F.greatest("cls_x", "cls_y").alias("y")).distinct()


def _components(sets: DataFrame, buckets: DataFrame) -> DataFrame | None:
    """node, component of the classes that are linked to a smaller one; None if there are none."""
    component, others = None, None
    known = materialize(_known(sets), "known")
    pivots = materialize(_pivot_pairs(buckets), "pivots")
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            pairs = _apart(pivots.where(F.col("turn") == turn).select("x", "y"), component)
        else:
            others = materialize(_others(buckets, component), "others")
            # pivots' pairs are checked, or in one component
            pairs = _remaining_pairs(others, component, known).join(pivots.select("x", "y"), ["x", "y"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            discard(pairs)
            continue
        found = _links(sets, known, pairs)
        discard(pairs)
        if not found.isEmpty():
            # components so far stand for the links that made them
            edges = found if component is None else found.unionByName(component.select(F.col("node").alias("x"), F.col("component").alias("y")))
            component = contract(edges, "x", "y")
        discard(found)
    discard(known, pivots, others)
    return component


#: Classes are in so many groups at most that each hold more than their part; those are met without a shuffle.
LARGE_GROUPS = 1000


def _groups(rows: DataFrame, component: DataFrame | None) -> DataFrame:
    """cls, grp, component_id of every class, checkpointed."""
    least = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("own"))
    if component is None:
        return least.select("cls", F.col("cls").alias("grp"), F.col("own").alias("component_id")).checkpoint()
    roots = component.select(F.col("component").alias("node")).distinct()
    component = component.unionByName(roots.withColumn("component", F.col("node")))
    least = least.join(component, F.col("cls") == F.col("node"), "left").select("cls", "own", F.col("component").alias("grp")).checkpoint()
    linked = least.where("grp is not null")
    groups = linked.groupBy(F.col("grp").alias("g")).agg(F.min("own").alias("component_id"), F.count("*").alias("classes")).checkpoint()
    share = linked.count() / LARGE_GROUPS
    large = linked.join(F.broadcast(groups.where(F.col("classes") > share)), F.col("grp") == F.col("g"))
    small = linked.join(groups.where(F.col("classes") <= share), F.col("grp") == F.col("g"))
    alone = least.where("grp is null").select("cls", F.col("cls").alias("grp"), F.col("own").alias("component_id"))
    columns = ["cls", "grp", "component_id"]
    return large.select(columns).unionByName(small.select(columns)).unionByName(alone).checkpoint()


def similar_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, thash, n_shingles, component_id, grp (equal for rows of one group; null if the set is empty)."""
    sets = document_sets(docs)
    buckets = _buckets(_postings(sets))
    component = _components(sets, buckets)
    rows = materialize(sets.select("doc_id", "thash", F.col("n").alias("n_shingles"), "cls"), "rows")
    discard(buckets, sets)
    # both sides are read from tables, so Spark may split the rows of a class with many copies
    named = _groups(rows, component)
    columns = ["doc_id", "thash", "n_shingles", "component_id", "grp"]
    full = rows.where("cls is not null").join(named, "cls")
    empty = rows.where("cls is null").withColumns({"component_id": F.col("doc_id"), "grp": F.lit(None).cast("long")})
    return full.select(columns).unionByName(empty.select(columns))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (null last, then by the text's hash).

    Rows with empty sets all stay. Rows equal in id and text are one.
    """
    groups = materialize(similar_groups(docs), "groups")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash")
    chosen = groups.where("grp is not null").groupBy("grp").agg(F.min(key).alias("k"))
    chosen = chosen.select(F.coalesce("k.doc_id", F.lit(-1)).alias("kept_id"), F.col("k.none").alias("kept_none"), F.col("k.thash").alias("kept_hash"))
    empty = groups.where("grp is null").select(F.coalesce("doc_id", F.lit(-1)).alias("kept_id"), F.col("doc_id").isNull().alias("kept_none"), F.col("thash").alias("kept_hash")).distinct()
    rows = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("doc"), F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)).alias("kept_id"), docs["doc_id"].isNull().alias("kept_none"), F.xxhash64(docs["text"]).alias("kept_hash"))
    keys = ["kept_id", "kept_none", "kept_hash"]
    once = rows.join(chosen, keys, "left_semi").dropDuplicates(keys).select("doc.*")
    return once.unionByName(rows.join(empty, keys, "left_semi").select("doc.*"))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS cls, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) GROUP BY sh),
m AS (SELECT doc_id, cls, n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) JOIN c USING (sh)),
p AS (SELECT cls, n, unnest(sh) AS g FROM c WHERE n > 0),
o AS (SELECT a.cls AS x, b.cls AS y, a.n AS nx, b.n AS ny, count(*) AS k FROM p a JOIN p b ON a.g = b.g AND a.cls < b.cls GROUP BY ALL),
e AS (SELECT x, y FROM o WHERE 100 * k >= 80 * (nx + ny - k)),
b AS (SELECT x AS u, y AS v FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT cls AS u, cls AS v FROM c WHERE n > 0 UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u),
l AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT m.doc_id, m.n::BIGINT AS n_shingles, coalesce(l.component_id, m.doc_id) AS component_id FROM m LEFT JOIN l ON m.n > 0 AND m.cls = l.u
"""
