"""Operator 3: n-gram Jaccard join with signature trees.

Documents are sets of word shingles; two link when their Jaccard similarity reaches the threshold. The
join is exact:

1. Equal sets are one class, represented by the smallest document id. A linked pair shares at least
   num/den of either set, so a class whose tokens are to a larger part in no other class has no
   links; its text goes no further: a bitmap of the ids that are left keeps back almost all others before
   texts are joined. Half of all tokens, chosen by hash, are counted for that: a
   class that they do not rule out stays in.
2. Candidates. Sizes fall into ranges such that linked sets are in the same or in neighbouring ranges.
   For a range the tokens are dealt into more parts than a linked pair can have differing tokens, so a
   linked pair agrees in whole parts; hashes of whole parts meet. A shared line or passage does not
   make a candidate, as a part mixes tokens of the whole text.
3. Classes that candidates connect form groups. In each group a signature tree is built: nodes
   hold the OR of their members' token bitmaps, their size range and their slack. A dual traversal
   from the root prunes node pairs whose greatest possible overlap is too small for any pair in
   them, skips what is linked already, and compares what is left by exact intersection. A group of
   more than ``chunk`` classes is parted by size, each range with the next one; what is larger still
   is cut into chunks, and pairs of chunks are tasks of their own.
4. Links become components by distributed star steps.

Tokens are 64-bit hashes of shingles. Defined cases: a text without words, or null, has an empty set and
links with nothing; rows that repeat are copies; a null id is no representative, and its row gets
its class's component; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import components
from tidelog.llm.shared import GOLDEN, LOWER, U64, WordHash, free, mix64, passing, release, shingles, small_batches, stash, text_bytes

BITS = 4096  # of a bitmap
LEAF, FAN = 8, 8


def token_set(b: bytes, words: WordHash, size: int) -> np.ndarray:
    return np.unique(shingles(words(b.translate(LOWER).split()), size))


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    if not len(s):
        return 0, 0
    return tuple(int(x) for x in np.array([mix64(s).sum(dtype=U64), np.bitwise_xor.reduce(mix64(s * GOLDEN + U64(1)))], U64).view(np.int64))


@lru_cache(maxsize=16)
def ranges(num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of size ranges, each at least den/num of the one before, and the parts of each range's scheme."""
    starts = [1]
    while starts[-1] < 1 << 33:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * den // num)))
    # sizes a, b below the next start: differing tokens are at most (a + b) (den - num) / (den + num)
    differ = [2 * (n - 1) * (den - num) // (den + num) for n in starts[1:]]
    return np.array(starts), np.array([d + 1 + SPARE if d else 0 for d in differ])


#: Parts beyond those that can differ: so many parts at least, and one more, agree, and empty ones need not be used.
SPARE = 2


def part_hashes(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the whole parts of a set, for its range's scheme and the next one's."""
    starts, parts = ranges(num, den)
    i = int(np.searchsorted(starts, len(s), side="right")) - 1
    out = []
    for j in (i, i + 1):
        k = int(parts[j])
        if not k or not len(s):
            continue
        part = (s >> U64(20)) % U64(k)
        order = np.argsort(part.astype(np.uint16 if k < 1 << 16 else np.int64), kind="stable")
        p = part[order]
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        total = np.add.reduceat(mix64(s[order] + U64(j)), first)
        used = p[first]
        if k - len(used) > SPARE:  # then the parts that agree may all be empty
            empty = np.setdiff1d(np.arange(k, dtype=U64), used)
            used, total = np.r_[used, empty], np.r_[total, np.zeros(len(empty), U64)]
        out.append(mix64(total + mix64(used + U64(j) * U64(1 << 32) + U64(7))))
    return np.concatenate(out) if out else np.zeros(0, U64)


def profile(docs: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(_id, _n, _d1, _d2): size and identity of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in batches:
            sets = [token_set(x, words, size) for x in text_bytes(b.column("_t"))]
            ids = [identity(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64())], ["_id", "_n", "_d1", "_d2"])

    return docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_t")).mapInArrow(run, "_id long, _n long, _d1 long, _d2 long")


def sent(docs: DataFrame, size: int, entries: Callable[[np.ndarray], np.ndarray], most: int | None, buckets: int) -> DataFrame:
    """(bucket, blob): 48-bit entries of each set with the class they are of, by range of the entry.

    ``most``: an entry that more classes of a blob have is sent for so many of them.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names: list[int] = []
        seen: set[tuple[int, int]] = set()
        total = 0

        def flush() -> pa.RecordBatch:
            h, who = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, who = h[order], who[order]
            if most and len(h) > most:
                kept = np.r_[np.ones(most, bool), h[most:] != h[:-most]]
                h, who = h[kept], who[kept]
            edge = np.searchsorted(h, np.array([(i << 48) // buckets for i in range(1, buckets)], U64))
            table = np.array(names, np.int64)
            blobs = []
            for x, w in zip(np.split(h, edge), np.split(who, edge), strict=True):
                used, back = np.unique(w, return_inverse=True)
                blobs.append(pickle.dumps(((x & U64(0xFFFFFFFF)).astype(np.uint32), (x >> U64(32)).astype(np.uint16), back.astype(np.uint16), table[used]), 5))
            return pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for b in batches:
            for x in text_bytes(b.column("_t")):
                s = token_set(x, words, size)
                d = identity(s)
                if d in seen:
                    continue
                seen.add(d)
                h = entries(s)
                held.append((h, np.full(len(h), len(names), np.int32)))
                names.append(d[0])
                total += len(h)
            if total > 800_000 or len(names) > 60_000:
                yield flush()
                held, names, total = [], [], 0
                seen.clear()
                release()
        if total:
            yield flush()

    return docs.select("_t").mapInArrow(send, "bucket int, blob binary")


def met(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a bucket and their classes, both in order."""
    cols = [pickle.loads(x) for x in table.column("blob").to_pylist()]
    h = np.concatenate([hi.astype(U64) << U64(32) | lo for lo, hi, _, _ in cols])
    d = np.concatenate([names[back] for _, _, back, names in cols])
    order = np.lexsort((d, h))
    return h[order], d[order]


def lone_tokens(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """(_name, _lone): how many of the counted tokens of a class no other class has, where there are any."""

    def half(s: np.ndarray) -> np.ndarray:
        return s[(s & U64(1)) == 0] >> U64(16)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        h, d = met(table)
        new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
        h, d = h[new], d[new]
        other = h[1:] != h[:-1]
        names, n = np.unique(d[np.r_[True, other] & np.r_[other, True]] if len(h) else d, return_counts=True)
        place = ((names.view(U64) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        used, first = np.unique(place[order], return_index=True)
        blobs = [pickle.dumps((names[x], n[x].astype(np.uint32)), 5) for x in np.split(order, first[1:])] if len(used) else []
        return pa.table({"bucket": pa.array(used, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def total(key: tuple, table: pa.Table) -> pa.Table:
        cols = [pickle.loads(x) for x in table.column("blob").to_pylist()]
        names, back = np.unique(np.concatenate([x for x, _ in cols]), return_inverse=True)
        n = np.zeros(len(names), np.int64)
        np.add.at(n, back, np.concatenate([x for _, x in cols]))
        return pa.table({"_name": pa.array(names), "_lone": pa.array(n)})

    # a class has its tokens in many buckets: counts travel packed, by range of the name
    each = sent(docs, size, half, 2, buckets).groupBy("bucket").applyInArrow(count, "bucket int, blob binary")
    return each.groupBy("bucket").applyInArrow(total, "_name long, _lone long")


def candidate_edges(docs: DataFrame, size: int, num: int, den: int, buckets: int) -> DataFrame:
    """(a, b): identities (first halves) of classes that agree in a whole part; a star for each part."""

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        h, d = met(table)
        first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        head = d[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(h) else d
        pair = np.unique(np.stack([head, d], axis=1)[head != d], axis=0)
        return pa.table({"a": pa.array(pair[:, 0]), "b": pa.array(pair[:, 1])})

    return sent(docs, size, lambda s: part_hashes(s, num, den) >> U64(16), None, buckets).groupBy("bucket").applyInArrow(meet, "a long, b long")


class Node:
    __slots__ = ("bits", "small", "large", "slack", "parts", "rows")


def bitmap(s: np.ndarray) -> np.ndarray:
    flags = np.zeros(BITS, np.uint8)
    flags[(s >> U64(7)).astype(np.int64) & (BITS - 1)] = 1
    return np.packbits(flags).view(U64)


def build(rows: np.ndarray, bits: np.ndarray, sizes: np.ndarray, slack: np.ndarray) -> Node:
    """A tree over rows, in an order that keeps like sets together."""
    level = []
    for i in range(0, len(rows), LEAF):
        n = Node()
        n.rows, n.parts = rows[i : i + LEAF], ()
        n.bits, n.small, n.large, n.slack = np.bitwise_or.reduce(bits[n.rows]), int(sizes[n.rows].min()), int(sizes[n.rows].max()), int(slack[n.rows].max())
        level.append(n)
    while len(level) > 1:
        up = []
        for i in range(0, len(level), FAN):
            n = Node()
            n.parts, n.rows = level[i : i + FAN], None
            n.bits, n.small, n.large, n.slack = np.bitwise_or.reduce([x.bits for x in n.parts]), min(x.small for x in n.parts), max(x.large for x in n.parts), max(x.slack for x in n.parts)
            up.append(n)
        level = up
    return level[0]


def tree_join(sets: list[np.ndarray], left: np.ndarray | None, num: int, den: int) -> tuple[np.ndarray, int]:
    """Union-find roots of sets by their links, and the number of sets compared exactly.

    ``left``: with two chunks, which sets are of the first; only pairs between the chunks are then looked at.
    """
    sizes = np.array([len(s) for s in sets])
    bits = np.array([bitmap(s) for s in sets])
    slack = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    order = np.lexsort((sizes, [s[0] for s in sets]))
    root = np.arange(len(sets))
    tried = 0

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def possible(a: Node, b: Node) -> bool:
        if a.large * den < b.small * num or b.large * den < a.small * num:
            return False
        overlap = min(int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.slack, b.slack), a.large, b.large)
        return overlap * (num + den) >= num * (a.small + b.small)

    if left is None:
        top = build(order, bits, sizes, slack)
        stack = [(top, top)]
    else:
        one, two = order[left[order]], order[~left[order]]
        stack = [(build(one, bits, sizes, slack), build(two, bits, sizes, slack))] if len(one) and len(two) else []
    while stack:
        a, b = stack.pop()
        if not possible(a, b):
            continue
        if a.rows is not None and b.rows is not None:
            n = np.bitwise_count(bits[a.rows][:, None] & bits[b.rows][None]).sum(axis=2, dtype=np.int64) + np.minimum(slack[a.rows][:, None], slack[b.rows][None])
            fits = n * (num + den) >= num * (sizes[a.rows][:, None] + sizes[b.rows][None])
            for x, y in zip(*np.nonzero(fits), strict=True):
                i, j = int(a.rows[x]), int(b.rows[y])
                if (a is b and x >= y) or (p := find(i)) == (q := find(j)):
                    continue
                tried += 1
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                    root[max(p, q)] = min(p, q)
        elif b.rows is not None or (a.rows is None and a is not b and len(a.parts) >= len(b.parts)):
            stack += [(x, b) for x in a.parts]
        elif a is b:
            stack += [(x, y) for i, x in enumerate(a.parts) for y in a.parts[i:]]
        else:
            stack += [(a, y) for y in b.parts]
    return np.array([find(i) for i in range(len(sets))], np.int64), tried


def by_size(members: DataFrame, num: int, den: int, chunk: int) -> DataFrame:
    """Groups of more than ``chunk`` classes parted by size: those whose sizes allow a link have a group in common.

    Ranges of sizes are a little wider than den/num, so they are of one range or of neighbouring ones, and a group holds
    a range and the next one.
    """
    large = members.groupBy("_comp").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > chunk).select(F.col("_comp").alias("_c2"))
    rows = members.join(large, F.col("_comp") == F.col("_c2"), "left")
    r = F.floor(F.log("_n") / F.log(F.lit(1.0001 * den / num))).cast("int")
    rows = rows.withColumn("_g", F.explode(F.when(F.col("_c2").isNotNull() & F.lit(num < den), F.array(r - 1, r)).otherwise(F.array(F.lit(None).cast("int")))))
    return rows.select("_id", "_t", F.when(F.col("_g").isNull(), F.col("_comp")).otherwise(F.xxhash64("_comp", "_g")).alias("_comp"))


def links(members: DataFrame, size: int, num: int, den: int, buckets: int, chunk: int) -> DataFrame:
    """(_id, _t, _n, _comp) to (a, b): stars of the links found in each candidate group."""
    members = by_size(members, num, den, chunk)
    count = members.groupBy("_comp").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > chunk).select(F.col("_comp").alias("_c2"), F.ceil(F.col("_m") / (chunk // 2)).cast("int").alias("_k"))
    rows = members.join(count, F.col("_comp") == F.col("_c2"), "left")
    mine = F.pmod(F.xxhash64("_id"), F.col("_k")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda x: F.least(x, mine) * F.col("_k") + F.greatest(x, mine) + 1)
    # task 0 of a bucket holds whole small groups; a large one has a task for each pair of chunks
    spread = rows.withColumn("_mine", F.coalesce(mine, F.lit(0))).withColumn("_task", F.explode(F.when(F.col("_k").isNull(), F.array(F.lit(0))).otherwise(pairs)))
    dealt = spread.withColumn("_where", F.when(F.col("_task") == 0, F.pmod(F.xxhash64("_comp"), F.lit(buckets))).otherwise(F.xxhash64("_comp", "_task")))

    def compare(table: pa.Table) -> pa.Table:
        words, a, b = WordHash(), [], []
        ids, comps, mine_, task, ks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_comp", "_mine", "_task", "_k"))
        sets = [token_set(x, words, size) for x in text_bytes(table.column("_t"))]
        groups: dict[tuple, list[int]] = {}
        for i, g in enumerate(zip(comps.tolist(), task.tolist(), strict=True)):
            groups.setdefault(g, []).append(i)
        for (_, t), rows_ in groups.items():
            left = None
            if t:
                k = int(ks[rows_[0]])
                lo, hi = divmod(t - 1, k)
                left = None if lo == hi else mine_[rows_] == lo
            root, _ = tree_join([sets[i] for i in rows_], left, num, den)
            for i, r in zip(rows_, root.tolist(), strict=True):
                if ids[i] != ids[rows_[r]]:
                    a.append(ids[i])
                    b.append(ids[rows_[r]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.select("_id", "_t", "_comp", "_mine", "_task", "_k", "_where").groupBy("_where").applyInArrow(compare, "a long, b long")


#: Places of a sieve: a power of two, of at least 1 << 15.
SIEVE = 1 << 24


def sieve(keys: DataFrame, key: str) -> Callable[[str], Column]:
    """A test of a column that holds for all these keys and, as it goes by a hash, for a few others.

    It is a bitmap of a fixed 2 MB, which the driver gathers and sends to the executors, so that a join with these keys
    need not move the texts of all others, whatever the planner makes of its sizes.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE)).cast("int")
    rows = keys.select(place(key).alias("_p")).groupBy(F.shiftright("_p", 15).alias("_part")).agg(F.bitmap_construct_agg(F.col("_p").bitwiseAND(F.lit((1 << 15) - 1)).cast("long")).alias("_bits"))
    bits = np.zeros(SIEVE >> 3, np.uint8)
    for r in rows.collect():
        bits[r["_part"] << 12 : r["_part"] + 1 << 12] = np.frombuffer(r["_bits"], np.uint8)
    sent_ = keys.sparkSession.sparkContext.broadcast(bits)

    def held(p: pa.Array) -> pa.Array:
        x = p.to_numpy(zero_copy_only=False)
        return pa.array((sent_.value[x >> 3] >> (x & 7) & 1) == 1)

    test = F.arrow_udf(held, "boolean")
    return lambda c: test(place(c))


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, num: int = 8, den: int = 10, chunk: int = 2048) -> DataFrame:
    """(_id, _n, _component) of each row: documents of one component are linked, directly or through others, at similarity num/den or more."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    prof = stash(profile(docs, size, text, key))
    classes = prof.filter("_n > 0").groupBy("_d1", "_d2", "_n").agg(F.min("_id").alias("_rep"))
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_t"))
    with passing(spark):
        lone = lone_tokens(texts, size, buckets)
        open_ = F.coalesce("_lone", F.lit(0)) <= F.col("_n") - F.ceil(F.col("_n") * num / den)
        wanted = stash(classes.filter("_rep is not null").join(lone, F.col("_d1") == F.col("_name"), "left").filter(open_).select("_rep", "_d1", "_n"))
        members = stash(wanted.join(texts.filter(sieve(wanted, "_rep")("_id")), F.col("_rep") == F.col("_id")).dropDuplicates(["_id"]).select("_id", "_t", "_d1", "_n"))
        groups = components(candidate_edges(members, size, num, den, buckets))
        grouped = members.join(groups, F.col("_d1") == F.col("node")).select("_id", "_t", "_n", F.col("component").alias("_comp"))
        linked = components(links(grouped, size, num, den, buckets, chunk))
    free(spark)
    final = classes.join(linked, F.col("_rep") == F.col("node"), "left").select(F.col("_d1").alias("_e1"), F.col("_d2").alias("_e2"), F.col("_n").alias("_e3"), F.coalesce("component", "_rep").alias("_c"))
    out = prof.join(final, (F.col("_d1") == F.col("_e1")) & (F.col("_d2") == F.col("_e2")) & (F.col("_n") == F.col("_e3")), "left")
    return out.select("_id", "_n", F.coalesce("_c", "_id").alias("_component"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents that represent their component, and those without an id; all columns."""
    joined = stash(jaccard_join(docs, text, key, **options))
    gone = joined.filter(F.col("_id").isNotNull() & (F.col("_id") != F.col("_component"))).select(F.col("_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(key).cast("long") == F.col("_gone"), "left_anti")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = jaccard_join(docs, size=3, num=90, den=100)
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"))
