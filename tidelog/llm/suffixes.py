"""Operator 9: substring dedup on bytes by suffix sorting with bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

1. Equal texts are one class; a copy of a smaller document goes whole, if long enough. What follows sees
   one document of each class.
2. Of every window of ``length`` bytes the least hash of its grams is its seed, so equal windows have
   equal seeds. Seeds of all documents meet, in sorted blobs by hash range; those found in two classes or
   more are told to their documents.
3. Documents cut out what their windows with shared seeds cover, and deal it by seed. Equal pieces are
   sent once by each batch and are one piece where they meet.
4. In each part the pieces are sorted to depth ``length``: buckets of 8-grams are refined by sorting their
   members on the bucket identifiers of later offsets; identifiers found at one depth are reused for the
   next, so depths are 8, 16, 32 and ``length``. Windows of one bucket are equal; the least document of a
   bucket keeps its window.
5. Runs of removed windows return to their documents, which are cut and hashed.

Only seeds, shared pieces and one copy of the texts move. A seed found in very many documents brings one piece
for each way its surroundings differ to one task; equal surroundings are merged before they are sent.

Defined cases: null texts are empty; a document under ``length`` bytes loses nothing; doc_id is a key, so rows
that repeat it are one document; a null id is never smaller than another, and its row stays whole.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import U64, mix64, release, slices, small_batches, stash, text_bytes

GRAM = 18
SLICE = 1 << 18  # bytes of text that are hashed at a time
_B = U64(0x9E3779B97F4A7C15)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM bytes, by doubling."""
    with np.errstate(over="ignore"):
        one = buf.astype(U64) + U64(1)
        b2 = _B * _B
        two = one[:-1] * _B + one[1:]
        four = two[:-2] * b2 + two[2:]
        eight = four[:-4] * (b2 * b2) + four[4:]
        b8 = b2 * b2 * b2 * b2
        sixteen = eight[:-8] * b8 + eight[8:]
        return mix64(sixteen[:-2] * b2 + two[16 : 16 + len(sixteen) - 2])


def window_seeds(buf: np.ndarray, length: int) -> np.ndarray:
    """48-bit seed of the window that starts at each place: the least hash of its grams."""
    m = gram_hashes(buf)
    need, have = length - GRAM + 1, 1
    while have * 2 <= need:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if need > have:
        m = np.minimum(m[: len(m) - (need - have)], m[need - have :])
    return m >> U64(16)


class Windows:
    """Windows of a batch of texts: starts, seeds, and runs of neighbours with one seed."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.buf = b"".join(texts)
        count = np.maximum(sizes - length + 1, 0)
        if not count.any():
            self.doc = self.first = self.last = np.zeros(0, np.int64)
            self.seed = np.zeros(0, U64)
            return
        seeds = window_seeds(np.frombuffer(self.buf, np.uint8), length)
        new = np.empty(len(seeds), bool)
        new[0] = True
        np.not_equal(seeds[1:], seeds[:-1], out=new[1:])
        has = np.flatnonzero(count)
        new[self.begin[has]] = True
        starts = np.flatnonzero(new)
        doc = np.searchsorted(self.begin[has], starts, side="right") - 1
        end = (self.begin + count)[has][doc]  # beyond the last window of the document
        inside = starts < end
        follow = np.r_[starts[1:], len(seeds)]
        self.doc, self.first, self.last = has[doc[inside]], starts[inside], np.minimum(follow, end)[inside]
        self.seed = seeds[self.first]


def refine(pointer: np.ndarray, later: np.ndarray) -> np.ndarray:
    """New bucket identifiers: members of each bucket sorted by the identifiers ``later`` holds for them; buckets of one keep theirs.

    Identifiers are the places at which buckets start, so order is kept and identifiers of unsplit buckets stay valid.
    """
    many = np.flatnonzero(np.bincount(pointer, minlength=len(pointer))[pointer] > 1)
    out = pointer.copy()
    if len(many):
        key = pointer[many].astype(np.int64) << 32 | later[many]
        order = np.argsort(key)
        key, place = key[order], np.arange(len(many), dtype=np.int32)
        bucket = (key >> 32).astype(np.int32)
        start = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], place, 0))
        head = np.maximum.accumulate(np.where(np.r_[True, bucket[1:] != bucket[:-1]], place, 0))
        out[many[order]] = bucket + start - head
    return out


def depth_sort(text: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers by which places are sorted and told apart to ``length`` bytes (for places that have so many)."""
    padded = np.r_[text, np.zeros(8, np.uint8)]
    n = len(text)
    gram = np.zeros(n, U64)
    for i in range(8):
        gram <<= U64(8)
        gram |= padded[i : i + n]
    order = np.argsort(gram)
    gram = gram[order]
    pointer = np.empty(n, np.int32)
    pointer[order] = np.maximum.accumulate(np.where(np.r_[True, gram[1:] != gram[:-1]], np.arange(n, dtype=np.int32), 0))
    del gram, order
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        later = np.zeros(n, np.int32)
        later[: n - step] = pointer[step:]
        pointer, depth = refine(pointer, later), depth + step
    return pointer


#: Pieces of a part are sorted in so many turns, by their seeds, as pieces of two seeds never match.
FINE = 16


def _pieces(w: Windows, ids: list[int], mine: np.ndarray, parts: int, length: int) -> Iterator[tuple[int, bytes]]:
    """Shared runs of a batch by part: (distinct pieces, and for each run its piece, document and place)."""
    part = ((w.seed[mine] >> U64(16)) * U64(parts) >> U64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    runs = mine[order]
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    first, last, doc = w.first[runs], w.last[runs], w.doc[runs]
    at = (first - w.begin[doc]).astype(np.int64)
    ids_ = np.array(ids, np.int64)
    for p in np.flatnonzero(np.diff(edge)).tolist():
        lo, hi = int(edge[p]), int(edge[p + 1])
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(w.buf[a : b + length - 1], len(known)) for a, b in zip(first[lo:hi].tolist(), last[lo:hi].tolist(), strict=True)], np.int32)
        fine = np.zeros(len(known), np.uint8)
        fine[which] = w.seed[runs[lo:hi]].astype(np.uint8) % FINE
        yield p, pickle.dumps((list(known), fine, which, ids_[doc[lo:hi]], at[lo:hi]), 5)


def repeated(pieces: list[bytes], least: np.ndarray, length: int) -> np.ndarray:
    """For every window of the pieces, one after the other: the least document that has an equal window."""
    size = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(size) - size
    windows = size - length + 1
    text = np.frombuffer(b"".join(pieces), np.uint8)
    owner = np.repeat(np.arange(len(pieces)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[owner]
    bucket = depth_sort(text, length)[place]
    best = np.full(len(text), np.iinfo(np.int64).max)
    np.minimum.at(best, bucket, least[owner])
    return best[bucket]


def shared_runs(blobs: list[bytes], length: int) -> dict[int, list[tuple[int, int]]]:
    """Blobs of one part to removed byte ranges by document."""
    cols = [pickle.loads(x) for x in blobs]
    out: dict[int, list[tuple[int, int]]] = {}
    for turn in range(FINE):
        known: dict[bytes, int] = {}
        which, docs, places = [], [], []
        for pieces, fine, w, d, at in cols:
            mine = fine == turn
            if mine.any():
                new = np.full(len(pieces), -1, np.int64)
                for i in np.flatnonzero(mine).tolist():
                    new[i] = known.setdefault(pieces[i], len(known))
                here = mine[w]
                which.append(new[w[here]])
                docs.append(d[here])
                places.append(at[here])
        if known:
            _removed(list(known), np.concatenate(which), np.concatenate(docs), np.concatenate(places), length, out)
    return out


def _removed(pieces: list[bytes], which: np.ndarray, docs: np.ndarray, places: np.ndarray, length: int, out: dict[int, list[tuple[int, int]]]) -> None:
    least = np.full(len(pieces), np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs)
    count = np.array([len(p) - length + 1 for p in pieces], np.int64)
    end = np.cumsum(count)
    best = repeated(pieces, least, length)
    gone = best < np.repeat(least, count)  # windows that even a piece's first document loses
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False])) if len(gone) else np.zeros(0, np.int64)
    runs: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        while a < b:  # a run of windows may go on into the next piece
            p = int(np.searchsorted(end, a, side="right"))
            stop = min(b, int(end[p]))
            runs.setdefault(p, []).append((a - int(end[p] - count[p]), stop - int(end[p] - count[p])))
            a = stop
    for p, d, at in zip(which.tolist(), docs.tolist(), places.tolist(), strict=True):
        spans = [(0, int(count[p]))] if d > least[p] else runs.get(p, ())
        if spans:
            out.setdefault(d, []).extend((at + a, at + b + length - 1) for a, b in spans)


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Sorted, touching ones joined."""
    out: list[list[int]] = []
    for a, b in spans[np.argsort(spans[:, 0])].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Documents with a key that is never null: both joins of their texts then ask for one and the same exchange, which Spark reuses."""
    return docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_t"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("_j"))


def duplicate_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 50) -> tuple[DataFrame, DataFrame]:
    """((_doc, _spans): pickled arrays of byte ranges to remove, found in first copies; (_copy): ids of texts that a smaller document has)."""
    if length < GRAM + 1:
        raise ValueError(f"length is at least {GRAM + 1}")
    spark = docs.sparkSession
    small_batches(spark, 500)
    buckets = 2 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts, lots = 6 * buckets, 4 * buckets
    rows = keyed(docs, text, key)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [xxhash.xxh3_128_intdigest(x) for x in text_bytes(b.column("_t"))]
            halves = np.array([(x >> 64, x & (2**64 - 1)) for x in d], U64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["_id", "_d1", "_d2"])

    named = stash(rows.select("_id", "_t").mapInArrow(identify, "_id long, _d1 long, _d2 long"))
    classes = named.groupBy("_d1", "_d2").agg(F.min("_id").alias("_first"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names: list[int] = []
        total = 0

        def flush() -> pa.RecordBatch:
            seed, who = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(seed)
            seed, who = seed[order], who[order]
            edge = np.searchsorted(seed, np.array([(i << 48) // buckets for i in range(1, buckets)], U64))
            table = np.array(names, U64)
            blobs = []
            for s, w in zip(np.split(seed, edge), np.split(who, edge), strict=True):
                used, back = np.unique(w, return_inverse=True)
                blobs.append(pickle.dumps(((s & U64(0xFFFFFFFF)).astype(np.uint32), (s >> U64(32)).astype(np.uint16), back.astype(np.uint16), table[used]), 5))
            return pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for b in batches:
            distinct = list(dict.fromkeys(text_bytes(b.column("_t"))))
            for s in slices([len(t) for t in distinct], SLICE):
                w = Windows(distinct[s], length)
                if len(w.seed):
                    held.append((w.seed, w.doc + len(names)))
                    names += [xxhash.xxh3_128_intdigest(t) >> 64 for t in distinct[s]]
                    total += len(w.seed)
            if total > 600_000 or len(names) > 60_000:
                yield flush()
                held, names, total = [], [], 0
                release()
        if held:
            yield flush()
        del held
        release()

    def meet(table: pa.Table) -> pa.Table:
        seeds, who = [], []
        for x in table.column("blob").to_pylist():
            lo, hi, back, names = pickle.loads(x)
            seeds.append(hi.astype(U64) << U64(32) | lo)
            who.append(names[back])
        seed, doc = np.concatenate(seeds), np.concatenate(who)
        order = np.argsort(seed)
        seed, doc = seed[order], doc[order]
        first = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]]) if len(seed) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(seed)])
        differs = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(seed) else np.zeros(0, bool)
        hit = np.repeat(differs, n)
        seed, doc = seed[hit], doc[hit]
        lot = (doc % U64(lots)).astype(np.int32)
        order = np.lexsort((doc, lot))
        seed, doc, lot = seed[order], doc[order], lot[order]
        at = np.flatnonzero(np.r_[True, lot[1:] != lot[:-1]]) if len(lot) else np.zeros(0, np.int64)
        blobs = [pickle.dumps((s, d), 5) for s, d in zip(np.split(seed, at[1:]), np.split(doc, at[1:]), strict=True)] if len(at) else []
        out = pa.table({"lot": pa.array(lot[at]), "blob": pa.array(blobs, pa.binary())})
        del seeds, who, order, hit, seed, doc
        release()
        return out

    def tell(table: pa.Table) -> pa.Table:
        """A lot of documents, each with all its shared seeds."""
        cols = [pickle.loads(x) for x in table.column("blob").to_pylist()]
        seed, doc = np.concatenate([c[0] for c in cols]), np.concatenate([c[1] for c in cols])
        order = np.lexsort((seed, doc))
        seed, doc = seed[order], doc[order]
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        return pa.table({"_e1": pa.array(doc[at].view(np.int64)), "_seeds": pa.array([x.tobytes() for x in np.split(seed, at[1:])], pa.binary())})

    told = rows.select("_t").mapInArrow(send, "bucket int, blob binary").groupBy("bucket").applyInArrow(meet, "lot int, blob binary").groupBy("lot").applyInArrow(tell, "_e1 long, _seeds binary")
    heard = told.join(classes, F.col("_e1") == F.col("_d1")).filter("_first is not null").select(F.col("_first").alias("_doc"), "_seeds")
    shared = rows.join(heard, F.col("_j") == F.col("_doc")).select("_id", "_t", "_seeds")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = text_bytes(b.column("_t")), b.column("_id").to_pylist()
            sets = [np.frombuffer(x, U64) for x in b.column("_seeds").to_pylist()]
            for s in slices([len(t) for t in texts], SLICE):
                w = Windows(texts[s], length)
                keep = np.zeros(len(w.seed), bool)
                mine = sets[s]
                edge = np.searchsorted(w.doc, np.arange(len(mine) + 1))
                for x, lo, hi in zip(mine, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if lo < hi:
                        keep[lo:hi] = x[np.minimum(np.searchsorted(x, w.seed[lo:hi]), len(x) - 1)] == w.seed[lo:hi]
                out = list(_pieces(w, ids[s], np.flatnonzero(keep), parts, length))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "blob"])
            release()

    def find(table: pa.Table) -> pa.Table:
        found = shared_runs(table.column("blob").to_pylist(), length)
        release()
        return pa.table({"_doc": pa.array(list(found), pa.int64()), "_span": pa.array([np.array(merged(np.array(x)), np.int64).tobytes() for x in found.values()], pa.binary())})

    found = shared.mapInArrow(deal, "part int, blob binary").groupBy("part").applyInArrow(find, "_doc long, _span binary")
    copies = named.join(classes.select(F.col("_d1").alias("_f1"), F.col("_d2").alias("_f2"), "_first"), (F.col("_d1") == F.col("_f1")) & (F.col("_d2") == F.col("_f2"))).filter("_id > _first").select(F.col("_id").alias("_copy")).distinct()
    return found.groupBy("_doc").agg(F.collect_list("_span").alias("_spans")), copies


def remove_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 50, bytes_too: bool = True) -> DataFrame:
    """(_id, _n_bytes, _kept, _spans, _sha256) of each document: its size, the bytes that stay (null without ``bytes_too``), the ranges that go, and the hash of what stays."""
    spans, copies = duplicate_spans(docs, text, key, length)
    known = spans.select("_doc", "_spans", F.lit(False).alias("_whole")).unionByName(copies.select(F.col("_copy").alias("_doc"), F.lit(None).cast("array<binary>").alias("_spans"), F.lit(True).alias("_whole")))
    rows = keyed(docs, text, key).join(known, F.col("_j") == F.col("_doc"), "left").select("_id", "_t", "_spans", "_whole")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, ranges, sizes = [], [], []
            for t, s, whole in zip(text_bytes(b.column("_t")), b.column("_spans").to_pylist(), b.column("_whole").to_pylist(), strict=True):
                if whole and len(t) >= length:
                    runs = [(0, len(t))]
                else:
                    runs = merged(np.frombuffer(b"".join(s), np.int64).reshape(-1, 2)) if s else []
                at, out = 0, []
                for x, y in runs:
                    out.append(t[at:x])
                    at = y
                kept.append(b"".join([*out, t[at:]]))
                ranges.append([{"start": x, "end": y} for x, y in runs])
                sizes.append(len(t))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(sizes, pa.int64()), pa.array(kept if bytes_too else [None] * len(kept), pa.binary()), pa.array(ranges, kind), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], ["_id", "_n_bytes", "_kept", "_spans", "_sha256"])

    return rows.mapInArrow(apply, "_id long, _n_bytes long, _kept binary, _spans array<struct<start:long,end:long>>, _sha256 string")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), bytes_too=False)
    removed = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(F.col("_id").alias("doc_id"), F.col("_n_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.col("_sha256").alias("kept_sha256"))
