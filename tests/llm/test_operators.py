"""Each operator against a brute-force version, an exact round trip or held-out labels, and on odd tables."""

import collections
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import chaining, components, jaccard, jpeg, lines, media, mixing, pieces, quality, suffixes, toxicity, urls
from tidelog.llm.queries import QUERIES, SQL


def texts(df):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]


# ---- 1


def all_paths(vocab, text):
    s, out = pieces.normalise(text), []

    def go(i, ids, w):
        if i == len(s):
            out.append((tuple(ids), w))
            return
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in vocab.score:
                go(j, [*ids, vocab.score[s[i:j]][0]], w + vocab.score[s[i:j]][1])
        if s[i] not in vocab.score:
            b = s[i].encode()
            go(i + 1, [*ids, *vocab.byte[list(b)].tolist()], w + len(b) * vocab.byte_score)

    go(0, [], 0.0)
    z = np.logaddexp.reduce([w for _, w in out])
    return {i: w - z for i, w in out}


def runs(vocab, text, keys, k, seed):
    s = pieces.Sampler(vocab, [text] * len(keys), keys, k, seed)
    return [[(tuple(s.ids([a])[0].tolist()), *x) for a, *x in g] for g in s.run()]


def test_sampling_is_gumbel_top_k():
    vocab = pieces.vocabulary(pieces.DEFAULT_MODEL, 1.0)
    exact = all_paths(vocab, "ab cd\n")
    everything = runs(vocab, "ab cd\n", [1], 1000, 3)[0]
    assert {x[0] for x in everything} == set(exact) and all(abs(exact[x[0]] - x[1]) < 1e-9 and x[3] == 1 for x in everything)
    n = 3000
    got = runs(vocab, "ab cd\n", list(range(n)), 3, 5)
    assert all(len({x[0] for x in g}) == 3 and [x[2] for x in g] == sorted((x[2] for x in g), reverse=True) for g in got)
    first = Counter(g[0][0] for g in got)
    second = Counter(g[1][0] for g in got)
    for i in sorted(exact, key=lambda i: -exact[i])[:3]:
        p = math.exp(exact[i])
        q = sum(math.exp(exact[j]) * p / (1 - math.exp(exact[j])) for j in exact if j != i)
        assert abs(first[i] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        assert abs(second[i] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3
    # inclusion scores weigh samples so that their sum estimates 1
    assert abs(np.mean([sum(math.exp(x[1]) / x[3] for x in g) for g in got]) - 1) < 0.01


def test_sampling_depends_on_the_row_alone(docs, odd):
    a = pieces.encode(docs, ["doc_id"]).collect()
    b = pieces.encode(docs.repartition(7).orderBy("n_chars"), ["doc_id"]).collect()
    key = lambda r: (r["doc_id"], r["_sample"])
    assert sorted(a, key=key) == sorted(b, key=key) and all(r["_round_trip"] for r in a)
    o = pieces.encode(odd, ["doc_id", "text"], k=2)
    assert all(r["_round_trip"] for r in o.collect())
    assert pieces.decode(o).filter("coalesce(text, '') <> _text").count() == 0


# ---- 2


def line_set(x):
    u = x.encode("utf-16-be")
    return frozenset(u[i : i + 18] for i in range(0, max(1, len(u) - 16), 2))


def test_lines_against_brute_force(docs):
    rows = [(i, n, x) for i, t in texts(docs) for n, x in enumerate(t.decode().split("\n")) if re.search(r"\S", x, re.ASCII)]
    names = {x: i for i, x in enumerate(dict.fromkeys(x for _, _, x in rows))}
    sets, root = [line_set(x) for x in names], list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    shared = Counter()
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            for j in where.get(g, ()):
                shared[j, i] += 1
            where.setdefault(g, []).append(i)
    for (i, j), n in shared.items():
        if 10 * n >= 8 * (len(sets[i]) + len(sets[j]) - n):
            root[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i, n, x in rows:
        c = find(names[x])
        first[c] = min(first.get(c, (i, n)), (i, n))
    want = {(i, n): first[find(names[x])] for i, n, x in rows}
    got = {(r["_id"], r["_no"]): (r["_class_id"], r["_class_no"]) for r in lines.line_classes(docs).collect()}
    # banding finds a pair at the threshold in all but 2 of 1000 cases
    assert got.keys() == want.keys() and sum(got[k] != want[k] for k in want) <= len(want) // 500


def classes_of(spark, texts, **options):
    got = lines.line_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options)
    return {r["_id"]: r["_class_id"] for r in got.collect()}


def brute_classes(texts):
    sets, root = [line_set(x) for x in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            n = len(s & sets[j])
            if 10 * n >= 8 * (len(s) + len(sets[j]) - n):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("block", [1024, 7])
def test_lines_of_large_buckets(spark, block):
    word = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:5]
    words = [word(i) for i in range(24)]
    # a template and variants of it, which are near it and mostly not near each other; and variants of variants
    texts = [" ".join(words)] + [" ".join([*words[: i % 24], f"v{i:04}", *words[i % 24 + 1 :]]) for i in range(300)]
    sets = [line_set(x) for x in texts]
    near = [sum(10 * len(s & t) >= 8 * len(s | t) for t in sets) for s in sets]
    assert near[0] == 301 and sorted(near)[150] < 50
    assert set(classes_of(spark, texts, block=block, small=1).values()) == set(classes_of(spark, texts, block=block).values()) == {0}
    # lines at 0.4 to 0.9 to one another, many to a bucket, in several components
    r = np.random.default_rng(4)
    texts = [" ".join(word(100 + 40 * (i % 3) + j) if r.random() > 0.06 else word(1000 + r.integers(0, 8)) for j in range(24)) for i in range(120)]
    assert 3 < len(set(brute_classes(texts).values())) < 90
    assert classes_of(spark, texts, block=block, small=1) == brute_classes(texts)


def test_lines_of_a_bucket_meet_by_size(spark, monkeypatch):
    # one bucket of 60 lines, of which no more than a few are of like sizes: they need no prefix join
    word = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:7]
    base = [" ".join(word(1000 * i + j) for j in range(int(2 * 1.3**i) % 900 + i)) for i in range(20)]
    texts = [x for i, b in enumerate(base) for x in (b + f" end{i}", b + " another", b + " of these lines, which grow" * (i + 1))]
    monkeypatch.setattr(lines, "bands_of", lambda rows, width: rows.select(F.xxhash64("_line").alias("_k"), F.lit(1).cast("long").alias("_band")))
    asked = []
    monkeypatch.setattr(lines, "prefixes", lambda *a, real=lines.prefixes: asked.append(a) or real(*a))
    assert classes_of(spark, texts) == brute_classes(texts) and not asked
    # of all sizes that can be similar, both lines are in one group, one of them low
    sizes = list(range(1, 260))
    of = spark.createDataFrame([(n, n) for n in sizes], "_k long, _n int")
    pairs = lines.pairs_of_small(lines.groups_of(of.select("_k", F.lit(1).alias("_band")), of, 8, 10), 10**6, 8, 10).collect()
    assert sorted((r["a"], r["b"]) for r in pairs) == [(a, b) for a in sizes for b in sizes if a < b and 10 * a >= 8 * b]


def test_prefixes_leave_most_tokens_where_they_are(spark, monkeypatch):
    texts = [" ".join(hashlib.md5(f"{i // 2} {j}".encode()).hexdigest()[:6] for j in range(60)) for i in range(40)]
    rows = lines.stash(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "_k long, _line string"))
    lists = lines.prefixes(rows, 9, 8, 10).collect()
    sets = rows.select("_k", F.array_distinct(lines.hashes_of("_line", 9)).alias("_set")).collect()
    length = {r["_k"]: len(r["_set"]) - math.ceil(len(r["_set"]) * 0.8) + 1 for r in sets}
    # equal lines share their whole prefix, in the same places
    by = {k: sorted((r["_pos"], r["_tok"]) for r in lists if r["_k"] == k) for k in length}
    assert all(by[i] == by[i + 1] and [p for p, _ in by[i]] == list(range(length[i])) for i in range(0, 40, 2))
    # a fifth is wanted; of four classes hardly a line reaches more than the first
    assert sum(length.values()) <= lines.reached(rows, 9, 8, 10).count() < 0.4 * sum(len(r["_set"]) for r in sets)


def test_lines_that_share_a_template_do_not_meet_pair_by_pair(spark, monkeypatch):
    word = lambda *of: hashlib.md5(repr(of).encode()).hexdigest()[:6]
    # 200 lines, each with seven words of its own, and after them ten that are near some of these
    texts = [" ".join(word(i, j) if (i + 7 * j) % 40 < 7 else word(j) for j in range(40)) for i in range(200)]
    texts += [x + " end" for x in texts[::20]]
    monkeypatch.setattr(lines, "bands_of", lambda rows, width: rows.select(F.xxhash64("_line").alias("_k"), F.lit(1).cast("long").alias("_band")))
    made = []

    def counted(*a, real=lines.rest_of_lists, **k):
        out = real(*a, **k)
        made.append(out.count())
        return out

    monkeypatch.setattr(lines, "rest_of_lists", counted)
    want = brute_classes(texts)
    assert len(set(want.values())) == 200 and classes_of(spark, texts) == want
    assert len(made) == 1 and made[0] < 10 * len(texts)
    # pairs of one token's list: those of different components, each once, in any number of blocks
    rows = spark.createDataFrame([(1, i, 0, 100, i % 3 if i < 9 else 3) for i in range(30)], "_tok long, _k long, _pos int, _n int, _c long")
    for block in (1024, 4):
        pairs = [(r["a"], r["b"]) for r in counted(rows, 8, 10, block).collect()]
        of = {r["_k"]: r["_c"] for r in rows.collect()}
        assert sorted(pairs) == [(a, b) for a in of for b in of if a < b and of[a] != of[b]]


def test_lines_ruled_out_by_bitmaps_do_not_meet_their_texts(spark, monkeypatch):
    word = lambda *of: hashlib.md5(repr(of).encode()).hexdigest()[:6]
    # lines of 3 to 60 words at many similarities to one of eight; all of them in one band
    r = np.random.default_rng(11)
    texts = [" ".join(word(i % 8, j) if r.random() > (i % 15) / 40 else word(i, j) for j in range(3 + 8 * (i % 8))) for i in range(120)]
    texts = list(dict.fromkeys(texts))
    monkeypatch.setattr(lines, "bands_of", lambda rows, width: rows.select(F.xxhash64("_line").alias("_k"), F.lit(1).cast("long").alias("_band")))
    asked = []
    monkeypatch.setattr(lines, "verified", lambda pairs, *a, real=lines.verified: asked.extend((r["a"], r["b"]) for r in pairs.select("a", "b").collect()) or real(pairs, *a))
    want = brute_classes(texts)
    assert classes_of(spark, texts, small=1000) == want and len(set(want.values())) > 20
    names = {r["k"]: r["i"] for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", F.xxhash64("t").alias("k")).collect()}
    asked, sets = {tuple(sorted((names[a], names[b]))) for a, b in asked}, [line_set(x) for x in texts]
    share = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(texts)) for i in range(j)}
    assert {p for p, x in share.items() if x >= 0.8} <= asked and len(asked) < 1.5 * sum(x >= 0.7 for x in share.values())


def test_a_sieve_holds_its_keys_and_few_others(spark):
    keys = spark.range(0, 3000, 3).selectExpr("id * 7919 as _key")
    held = lines.sieve(keys, "_key", 1000)
    left = {r["k"] for r in spark.range(30000).selectExpr("id * 7919 as k").filter(held("k")).collect()}
    assert {3 * i * 7919 for i in range(1000)} <= left and len(left) < 1000 + 0.2 * 29000


def test_lines_by_every_character(spark, docs):
    apart = ["https://a.org/x", "https://a.org/y", "2024-01-01T10:00", "2024-01-01T11:00", "Andththwhwh.", "Andththwhes.", "今日は天気がとても良いので散歩に行きます", "今日は天気がとても良くないので家にいます", "https://example.com/pricing-for-teams", "https://elsewhere.org/terms"]
    got = lines.drop_lines(spark.createDataFrame(list(enumerate(apart)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(len(apart)))
    texts = [x for (x,) in docs.select("text").filter("text is not null").limit(20).collect()] + ["x" * 8, "y" * 9, "z" * 10, "ab" * 68, "é🙂" * 200]
    rows = lines.stash(spark.createDataFrame([(x,) for x in texts], "_line string"))
    full = rows.select("_line", F.array_distinct(lines.hashes_of("_line", 9)).alias("s")).collect()
    assert all(len(r["s"]) == len(line_set(r["_line"])) for r in full)
    seen = lines.hashed(rows, 9).select("_k", F.explode(F.array(*(f"_h{i}" for i in range(4)))).alias("_h")).groupBy("_k").agg(F.collect_set("_h").alias("h")).collect()
    assert {frozenset(r["h"]) for r in seen} == {frozenset(r["s"]) for r in full}


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "a line that is there twice\nand one more"), (5, "a line that is there twice\nthe rest of the first"), (5, "unique text that must stay\nas must this second line"), (None, "a line that is there twice"), (None, "another one without an id")]
    got = lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "and one more"), (5, "the rest of the first"), (5, "unique text that must stay\nas must this second line"), (None, "a line that is there twice"), (None, "another one without an id")], key=repr)


def test_lines_odd(odd, empty):
    assert lines.line_classes(empty).count() == 0 and lines.drop_lines(empty).count() == 0
    clash = ["_id", "_no", "_k", "_nos", "_row", "_new", "_gone", "_hash", "_line", "_text", "component"]
    left = lines.drop_lines(odd.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash))))
    assert left.columns == [*odd.columns, *clash]
    left = left.collect()
    assert {r["doc_id"] for r in left} == {1, 2, 3, None, 4, 6} and all([r[c] for c in clash] == list(range(len(clash))) for r in left)


# ---- 3


def brute_links(rows, size, num, den):
    sets = {}
    for i, t in rows:
        w = t.translate(jaccard.LOWER).split()
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            n = len(sets[i] & sets[j])
            if n and den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "num", "den", "chunk"), [(3, 90, 100, 2048), (5, 8, 10, 2048), (3, 6, 10, 4)])
def test_jaccard_against_brute_force(docs, size, num, den, chunk):
    got = {r["_id"]: (r["_n"], r["_component"]) for r in jaccard.jaccard_join(docs, size=size, num=num, den=den, chunk=chunk).collect()}
    assert got == brute_links(texts(docs), size, num, den)


def test_large_jaccard_groups_meet_by_size(spark):
    sizes = [int(10 * 1.07**i) + j for i in range(60) for j in range(3)]
    rows = spark.createDataFrame([(i, "", n, i % 2) for i, n in enumerate(sizes)] + [(1000, "", 5, 7), (1001, "", 500, 7)], "_id long, _t string, _n long, _comp long")
    groups = {}
    for r in jaccard.by_size(rows, 90, 100, 20).collect():
        groups.setdefault(r["_comp"], set()).add(r["_id"])
    assert {1000, 1001} in groups.values() and max(map(len, groups.values())) < 20
    met = {(a, b) for g in groups.values() for a in g for b in g}
    of = range(len(sizes))
    assert all((a, b) in met for a in of for b in of if a % 2 == b % 2 and 10 * sizes[a] >= 9 * sizes[b] and 10 * sizes[b] >= 9 * sizes[a])


def test_jaccard_moves_no_texts_that_are_ruled_out(spark, monkeypatch):
    rows = spark.range(20_000).select((F.col("id") - 10_000).alias("_id"))
    some = rows.filter("_id % 100 = 0")
    got = rows.unionByName(spark.createDataFrame([(None,)], "_id long")).filter(jaccard.sieve(some, "_id")("_id"))
    assert got.join(some, "_id").count() == some.count() == 200 and got.count() < 210
    assert rows.filter(jaccard.sieve(some.limit(0), "_id")("_id")).count() == 0
    # of texts with no near copy few get to the join
    texts = [" ".join(f"w{i if i < 995 else 0}x{j}" for j in range(30)) + " end" * (i > 995) for i in range(1000)]
    asked = []

    def counted(keys, key, real=jaccard.sieve):
        asked.append(keys.count())
        return real(keys, key)

    monkeypatch.setattr(jaccard, "sieve", counted)
    got = {r["_id"]: r["_component"] for r in jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=3, num=90, den=100).collect()}
    assert got == {i: i if i < 995 else 0 for i in range(1000)} and asked == [2]


def test_jaccard_odd(odd, empty):
    got = Counter((r["_id"], r["_n"], r["_component"]) for r in jaccard.jaccard_join(odd.withColumn("_rep", F.lit(1)), size=3, num=90, den=100).collect())
    assert got[(5, 5998, 4)] == 2 and got[(1, 0, 1)] == got[(2, 0, 2)] == got[(6, 1, 6)] == 1
    assert jaccard.jaccard_join(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)} | {i: 100 for i in range(100, 150)}


def test_steps_of_few_edges_are_one_task(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1 + i % 3) for i in range(0, 400) if i % 20 < 17], "a long, b long")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [components.components(edges)]
        monkeypatch.setattr(components, "FEW", 0)
        got.append(components.components(edges))
        assert got[0].rdd.getNumPartitions() == 1 < got[1].rdd.getNumPartitions()
        assert {tuple(r) for r in got[0].collect()} == {tuple(r) for r in got[1].collect()} and got[0].count() == got[1].count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


# ---- 4


def test_urls(spark):
    caps = spark.createDataFrame([(1, "http://u:p@WWW.a.example.com:80/x/y?q", 5), (2, "https://a.example.com/z", 5), (3, "https://a.example.com/z", 10), (4, None, 5), (5, "nonsense", 5), (6, "https://b.example.com/", None), (7, "http://example.com", 3)], "page_id long, url string, day long")
    lists = spark.createDataFrame([("example.com", 4, "block"), ("a.example.com/x", 1, "release"), ("a.example.com", 8, "release"), ("a.example.com", 8, "block"), (None, 1, "block")], "key string, day long, action string")
    got = {r["page_id"]: r["_verdict"] and (r["_verdict"]["action"], r["_verdict"]["key"]) for r in urls.url_filter(caps, lists).collect()}
    assert got == {1: ("release", "a.example.com/x"), 2: ("block", "example.com"), 3: ("block", "a.example.com"), 4: None, 5: None, 6: None, 7: None}
    assert {r["_verdict"] for r in urls.url_filter(caps, lists.limit(0)).collect()} == {None}
    assert urls.url_filter(caps.limit(0), lists).count() == 0


def test_urls_long_histories_and_clashing_names(spark):
    # every third day changes the host's state; rows repeat; a column of each inner name
    lists = spark.range(0, 3000, 3).selectExpr("'a.example.com' as key", "id as day", "if(id % 2 = 0, 'block', 'release') as action")
    clash = ["_host", "_first", "_h", "_f", "_day", "_key", "_row", "_rank", "_last", "key", "action"]
    caps = spark.range(0, 4000).selectExpr("'http://a.example.com/' as url", "id div 2 * 2 as day", *(f"'{c}' as {c}" for c in clash), "1 as _verdict")
    out = urls.url_filter(caps, lists)
    assert out.columns == ["url", "day", *clash, "_verdict"]
    got = out.collect()
    assert len(got) == 4000 and all(r[c] == c for r in got for c in clash)
    for r in got:
        since = min(r["day"] // 3 * 3, 2997)
        assert tuple(r["_verdict"]) == ("block" if since % 2 == 0 else "release", "a.example.com", since)


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    for name, sql in SQL.items():
        got = QUERIES[name](spark, sf)
        rel = con.sql(sql)
        pick = [rel.columns.index(c) for c in got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in pick) for r in rel.fetchall())


# ---- 5


def test_toxicity(spark, docs, odd):
    s = toxicity.Scorer({"scum": 8.0}, {"lowei": 7.0}, -3.5)
    plain, said, negated, aimed = (s.score(t)[0] for t in ("They are scum.", "She said scum is here.", "This is not scum.", "You, scum."))
    assert said < 0.3 and negated < 0.3 and aimed >= plain > 0.9 and s.score("the weather is fine")[0] < 0.1 and s.score(None) == s.score("")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = toxicity.score(big, toxicity.learn(toxicity.training_rows(big.select("doc_id", "text"), labels)), ["doc_id"])
    held = out.join(labels, "doc_id").filter(toxicity.held_out()).selectExpr("toxic", "cast(_score >= 0.3 as int) as p").collect()
    hit, said_, real = sum(r["p"] * r["toxic"] for r in held), sum(r["p"] for r in held), sum(r["toxic"] for r in held)
    assert hit >= 0.9 * real and hit >= 0.9 * said_
    assert toxicity.score(odd, ({}, {}, -3.5)).count() == odd.count()


def test_threats_are_patterns_of_words(spark):
    s = toxicity.Scorer({}, {}, -3.5)
    toxic = lambda t: s.score(t)[0] >= 0.3
    assert all(toxic(t) for t in ("I will kill you.", "We will shoot them tomorrow.", "I'll hurt you", "Wir werden dich töten!", "The weather. They should all hurt her"))
    assert not any(toxic(t) for t in ("I will not kill you.", "He said I will kill you.", "I hurt my knee.", "It will kill the mood. You are kind.", "You will go", "kill", "you kill"))
    # a pattern common in clean texts loses its weight, one common in toxic texts keeps it
    row = lambda t, y, n: [(f"{t} {i}", y) for i in range(n)]
    texts = spark.createDataFrame(row("We will kill them", 1, 200) + row("please hurt you", 0, 200) + row("fine day", 0, 400), "text string, label int")
    w = toxicity.threat_weights(texts, 200, 600)
    assert w["K"] > 3.5 and w["k"] < 0.2
    assert toxicity.learn(texts.limit(0)) == ({}, {}, -3.5, toxicity.THREAT_WEIGHTS)


def test_toxicity_carries_any_column_and_empty_tables(spark):
    lexicon = ({"scum": 8.0}, {}, -3.5)
    docs = spark.createDataFrame([(1, "scum", "a", 7), (1, "scum", "b", 8), (None, None, None, None), (2, "", "c", 9)], "doc_id long, text string, _t string, _c0 long")
    got = toxicity.score(docs, lexicon).collect()
    assert [(r["doc_id"], r["text"], r["_t"], r["_c0"], r["_clauses"]) for r in got] == [(1, "scum", "a", 7, 1), (1, "scum", "b", 8, 1), (None, None, None, None, 0), (2, "", "c", 9, 0)]
    assert toxicity.score(docs.limit(0), lexicon).count() == 0
    long_ = spark.createDataFrame([(1, "word " * 300_000 + "scum")], "doc_id long, text string")
    assert toxicity.score(long_, lexicon).first()["_score"] > 0.9


# ---- 6


def test_passages(spark, docs):
    rows = texts(docs)
    words = {i: t.translate(chaining.LOWER).split() for i, t in rows}
    got = {}
    for r in chaining.passages(docs).collect():
        got.setdefault(r["_id"], []).append((r["_start"], r["_end"]))
        assert r["_ref"] < r["_id"] and r["_end"] - r["_start"] >= 40
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            x = tuple(words[i][p : p + 50])
            if first.setdefault(x, i) < i:
                assert any(a <= p and p + 50 <= b for a, b in got.get(i, ())), (i, p)
    base = [f"a{i}" for i in range(200)]
    fuzzy = [w if i % 17 else "zz" for i, w in enumerate(base[50:130])]
    small = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(["q1", "q2", *fuzzy, "q3"])), (3, None), (None, " ".join(base))], "doc_id long, text string")
    out = chaining.passages(small).collect()
    assert [(r["_id"], r["_ref"]) for r in out] == [(2, 1)] and out[0]["_end"] - out[0]["_start"] >= 75


def test_passages_whose_sentences_occur_earlier(spark):
    one, two = [f"s{i}" for i in range(30)], [f"t{i}" for i in range(30)]
    parts = [one, two, [*(f"u{i}" for i in range(20)), *one, *two], [*(f"v{i}" for i in range(20)), *one, *two], one]
    small = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(parts)], "doc_id long, text string")
    got = {(r["_id"], r["_ref"], r["_start"], r["_end"]) for r in chaining.passages(small).collect()}
    assert got == {(3, 2, 20, 80)}


@pytest.mark.parametrize(("size", "every"), [(50, 10), (50, 8), (50, 7), (80, 7)])
def test_fuzzy_passages_have_seeds(spark, size, every):
    rows = []
    for i in range(40):
        base = [f"w{i}x{j}" for j in range(size)]
        near = [f"n{i}x{j}" if j % every == i % every else w for j, w in enumerate(base)]
        rows += [(i, " ".join([f"p{i}x{j}" for j in range(20)] + base)), (100 + i, " ".join([f"q{i}x{j}" for j in range(20)] + near))]
    got = {(r["_id"], r["_ref"]) for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(100 + i, i) for i in range(40)}


def test_passage_with_pieces_in_smaller_documents(spark):
    # a passage of 70 words, pieces of which five smaller documents have, and five between the two that have it whole
    whole = [f"w{i}" for i in range(70)]
    pieces_ = [whole[i * 12 : i * 12 + 22] for i in range(5)]
    rows = [(i, [f"a{i}", *p]) for i, p in enumerate(pieces_)] + [(10, ["x1", *whole, "x2"])] + [(20 + i, [f"b{i}", *p]) for i, p in enumerate(pieces_)] + [(30, ["y1", "y2", *whole])]
    # two exact passages with unlike words between them
    rows += [(40, [f"l{i}" for i in range(45)] + [f"m{i}" for i in range(60)] + [f"n{i}" for i in range(45)]), (41, [f"l{i}" for i in range(45)] + [f"o{i}" for i in range(60)] + [f"n{i}" for i in range(45)])]
    small = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    got = {(r["_id"], r["_ref"], r["_start"], r["_end"]) for r in chaining.passages(small).collect()}
    assert got == {(30, 10, 2, 72), (41, 40, 0, 45), (41, 40, 105, 150)}


def test_fuzzy_passage_whose_partner_is_neither_first_nor_nearest(spark):
    # every seed of the passage is in a smaller document than the partner and in one between the two
    whole = [f"w{i}" for i in range(80)]
    near = [w if i % 9 else f"n{i}" for i, w in enumerate(whole)]
    pieces_ = [near[i : i + 22] for i in range(0, 70, 12)]
    rows = [(i, [f"a{i}", *p]) for i, p in enumerate(pieces_)] + [(10, ["x1", *whole, "x2"])] + [(20 + i, [f"b{i}", *p]) for i, p in enumerate(pieces_)] + [(30, ["y1", "y2", *near])]
    got = [(r["_id"], r["_ref"], r["_start"], r["_end"]) for r in chaining.passages(spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")).collect()]
    assert [r[:2] for r in got] == [(30, 10)] and got[0][2] <= 6 and got[0][3] == 82


def test_passages_of_seeds_with_many_places(spark):
    # a line of 30 words that all have: two documents go on alike with runs of four words, which have few seeds, others don't
    line = [f"l{i}" for i in range(30)]
    after = [f"e{i}" if i % 5 else f"f{i}" for i in range(1, 25)]
    rows = [(i, [f"a{i}x{j}" for j in range(9)] + line + [f"b{i}x{j}" for j in range(30)]) for i in range(60)]
    rows[20] = (20, ["c1", *line, *after, "c2"])
    rows[40] = (40, ["d1", "d2", *line, *(w if w[0] == "e" else f"g{w}" for w in after), "d3"])
    small = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string")
    got = [[(r["_id"], r["_ref"], r["_start"], r["_end"]) for r in chaining.passages(small, hot=hot).collect()] for hot in (4, 10**6)]
    assert sorted(got[0]) == sorted(got[1]) and [r[:2] for r in got[0]] == [(40, 20)] and got[0][0][2] == 2 and got[0][0][3] >= 50


def test_rest_of_matches_against_brute_force():
    rng = np.random.default_rng(4)
    rows = np.unique(np.stack([rng.integers(0, 9, 900) ** 2 // 20 * 2, rng.integers(0, 40, 900), rng.integers(0, 20, 900)], axis=1), axis=0)
    seed, doc, at = rows[:, 0].astype(np.uint64), rows[:, 1], rows[:, 2]
    got = Counter((int(i), int(j)) for one, two in chaining.all_matches(seed, doc, doc % 3 == 0, 50) for i, j in zip(one, two, strict=True))
    assert got == Counter((i, j) for i, a in enumerate(rows.tolist()) for j, b in enumerate(rows.tolist()) if a[1] % 3 == 0 and a[0] == b[0] and b[1] < a[1])
    which, o = chaining.open_seeds(seed, doc, at)
    done = Counter(chaining.matches(*rows.T)[0].tolist())
    for i, left in zip(which.tolist(), o["left"].tolist(), strict=True):
        assert left == (done[i] < sum(b[0] == seed[i] and b[1] < doc[i] for b in rows.tolist()))
    assert set(which.tolist()) == {i for i in range(len(rows)) if len(set(doc[seed == seed[i]])) > 1}


def test_matches_of_a_seed():
    rng = np.random.default_rng(3)
    rows = np.unique(np.stack([rng.integers(0, 9, 900) ** 2 // 20, rng.integers(0, 40, 900), rng.integers(0, 20, 900)], axis=1), axis=0)
    want = Counter()
    for s, d, x in rows.tolist():
        less = [r for r in rows.tolist() if r[0] == s and r[1] < d]
        if less:
            near = max(less)
            want.update({(s, d, x, *less[0][1:]), (s, d, x, *near[1:])} if near[1] != less[0][1] else {(s, d, x, *less[0][1:])})
    one, two = chaining.matches(*rows.T)
    assert Counter((*rows[i].tolist(), *rows[j, 1:].tolist()) for i, j in zip(one, two, strict=True)) == want


def test_edit_matches_is_the_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 30)).tolist() for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert chaining.edit_matches(a, b) == best[-1][-1]


def test_passages_leave_no_steps_behind(spark, monkeypatch):
    word = lambda *of: hashlib.md5(repr(of).encode()).hexdigest()[:6]
    texts = [" ".join(word(0 if 20 <= j < 100 else i, j) for j in range(140)) for i in range(3)]
    made = []
    monkeypatch.setattr(chaining, "stash", lambda df, real=chaining.stash: made.append(real(df)) or made[-1])
    got = chaining.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    fs = spark._jvm.org.apache.hadoop.fs.Path
    there = [(p := fs(x.stashed)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for x in made]
    # seeds' matches, first chains and the rest's matches are gone; what the result reads is there
    assert there == [False, False, True, False, True, True]
    assert {(r["_id"], r["_ref"], r["_start"], r["_end"]) for r in got.collect()} >= {(1, 0, 20, 100)}


def test_passages_odd(odd, empty):
    got = {(r["_id"], r["_ref"], r["_start"], r["_end"]) for r in chaining.passages(odd.withColumns({"_id": F.lit(1), "_doc": F.lit(2), "_t": F.lit("x")})).collect()}
    assert got == {(5, 4, 0, 6000)} and chaining.passages(empty).count() == 0


def test_chains_are_collinear():
    x, y = np.array([0, 10, 20, 30, 12]), np.array([5, 15, 2, 35, 17])
    best = chaining.chains(x, y, 5)[0]
    assert [int(x[i]) for i in best] == sorted(int(x[i]) for i in best) and [int(y[i]) for i in best] == sorted(int(y[i]) for i in best)


# ---- 7


def test_sainte_lague_against_one_seat_at_a_time():
    r = np.random.default_rng(3)
    for _ in range(50):
        votes, seats = r.integers(0, 50, r.integers(1, 8)).astype(float), int(r.integers(0, 60))
        got = np.zeros(len(votes), int)
        for _ in range(seats if votes.sum() else 0):
            got[int(np.argmax(votes / (2 * got + 1)))] += 1
        assert mixing.sainte_lague(votes, seats).tolist() == got.tolist()


def test_mixing(docs, odd, empty):
    rows = mixing.mix(docs, ["doc_id", "source"]).collect()
    by = {}
    for r in rows:
        assert 0 <= r["_taken"] <= 2 * r["_size"]
        t = by.setdefault(r["source"], [0, 0, r["_target"]])
        t[0] += r["_size"]
        t[1] += r["_taken"]
    assert all(abs(t[1] - t[2]) <= 32 for t in by.values())
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(5), ["doc_id", "source"]).collect())
    names = sorted(by)
    sizes, weights = np.array([by[n][0] for n in names], float), np.array([(3, 1, 2)[i % 3] for i in range(len(names))], float)
    assert np.allclose([by[n][2] for n in names], mixing.targets(sizes, weights, 1.5 * sizes.sum(), 2.0))
    assert np.allclose(sum(t[2] for t in by.values()), 1.5 * sizes.sum())
    assert mixing.mix(empty, ["doc_id"]).count() == 0 and mixing.mix(odd, ["doc_id"]).count() == odd.count()
    taken = mixing.take(mixing.mix(docs), docs.columns)
    assert taken.select(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")))).first()[0] == sum(r["_taken"] for r in rows)


# ---- 8


def test_jpeg_round_trips():
    r = np.random.default_rng(1)
    shapes = [(16, 16), (48, 32), (64, 80)]
    n = sum(jpeg.layout(w, h, jpeg.Script().sampling)[1] for w, h in shapes)
    for density, top in ((0.03, 200), (0.5, 3), (0.95, 256)):
        c = np.where(r.random((n, 64)) < density, r.integers(-top + 1, top, (n, 64)), 0).astype(np.int32)
        back, images = jpeg.read(jpeg.write(c, shapes, [b""] * 3))
        assert (back == c).all() and [(i.width, i.height) for i in images] == shapes
    flat = np.zeros((6, 64), np.int32)
    flat[:, 0] = 8 * 50
    x = jpeg.rgb(jpeg.samples(flat), jpeg.read(jpeg.write(flat, [(16, 16)], [b""]))[1][0])
    assert x.shape == (16, 16, 3) and x[0, 0].tolist() == [min(255, round(178 + 1.402 * 50)), round(178 - 0.344136 * 50 - 0.714136 * 50), 255]


def test_media(docs, odd, empty):
    for df in (docs, odd):
        got = media.media_digest(df, ["text"]).collect()
        for r in got:
            b = (r["text"] or "").encode()
            p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    alone = {r["text"]: tuple(r) for r in media.media_digest(docs.limit(20), ["text"]).collect()}
    assert all(alone[r["text"]] == tuple(r) for r in media.media_digest(docs, ["text"]).collect() if r["text"] in alone)
    files = media.encode_media(odd, ["doc_id"])
    assert all(len(r["_rgb"]) == 3 * r["_height"] * r["_width"] for r in media.decode_media(files, ["doc_id"]).collect())
    assert media.media_digest(empty, ["doc_id"]).count() == 0


# ---- 9


def brute_removed(rows, length=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first.setdefault(t[p : p + length], i) < i:
                gone[p : p + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffixes_against_brute_force(spark, sf, docs, empty):
    got = {r[0]: tuple(r)[1:] for r in suffixes.op9_suffix_dedup(spark, sf).collect()}
    assert got == brute_removed(texts(docs))
    r = np.random.default_rng(5)
    rows = [(i, "".join(r.choice(list("ab"), r.integers(0, 400)))) for i in range(40)] + [(100 + i, "pour " * (20 + i)) for i in range(8)]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["_id"]: r["_sha256"] for r in suffixes.remove_spans(small).collect()}
    assert kept == {i: x[3] for i, x in brute_removed([(i, t.encode()) for i, t in rows]).items()}
    assert suffixes.remove_spans(empty).count() == 0


def test_suffixes_odd(odd):
    got = Counter((r["_id"], r["_n_bytes"], len(r["_kept"])) for r in suffixes.remove_spans(odd).collect())
    n = next(k[1] for k in got if k[0] == 4)
    assert got[(4, n, n)] == 1 and got[(5, n, 0)] == 2 and got[(1, 0, 0)] == 1


# ---- 10


def brute_counts(t):
    words = t.split()
    seen, dup = set(), 0
    for x in t.split(b"\n"):
        if x.split():
            dup += x in seen
            seen.add(x)
    grams = Counter(zip(words, words[1:], words[2:]))
    cover = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(len(w.decode()) for w in words), sum(t.count(c.encode()) for c in "#*$%&|<>") if words else 0, dup, len(cover)


def test_small_groups_are_judged_by_language_and_table(spark):
    def plain(i):
        rng = np.random.default_rng(i)
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 10, 80)]
        return " ".join(w.capitalize() + "." if u < 0.15 else w for w, u in zip(words, rng.random(80), strict=True))

    wild = " ".join(f"#$%{j}&*|<>" for j in range(60))
    rows = [(i, "en", "s", plain(i)) for i in range(300)] + [(1000 + i, "en", f"small{i}", plain(i)) for i in range(5)] + [(2000, "en", "tiny", wild), (3000, "xx", "s", wild), (3001, "xx", None, plain(7)), (3002, None, "s", plain(8))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    got = {r["doc_id"]: (r["_kept"], r["_distance"]) for r in quality.quality_rules(docs, carry=["doc_id"]).collect()}
    assert len(got) == len(rows) and all(d is not None for _, d in got.values())
    assert not got[2000][0] and not got[3000][0] and all(got[i][0] for i in (1000, 1004, 3001, 3002))
    few = quality.quality_rules(docs.limit(20), carry=["doc_id"]).collect()
    assert len(few) == 20 and all(r["_kept"] and r["_distance"] is None for r in few)


def test_quality(docs, odd, empty, spark):
    for df in (docs, odd):
        for r in quality.text_stats(df, ["text"]).collect():
            assert tuple(r["_stats"])[:5] == brute_counts((r["text"] or "").encode())
    assert quality.quality_rules(empty).count() == 0
    assert quality.quality_rules(odd.withColumn("_stats", F.lit(1))).count() == odd.count()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), carry=["doc_id"]).join(labels, "doc_id").filter("not _base_failed")
    n = {(r["quality"], r["_kept"]): r["count"] for r in out.groupBy("quality", "_kept").count().collect()}
    assert n[1, True] >= 0.995 * (n[1, True] + n.get((1, False), 0)) and n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))


def test_mixing_clashing_names(odd, empty):
    clash = ["_size", "_taken", "_run", "_source_size", "_target", "__size", "_source", "_order", "_shard", "_c0", "v", "n", "w", "words", "quota", "target", "shards"]
    rows = odd.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash)))
    mixed = mixing.mix(rows)
    assert mixed.columns == [*rows.columns, "___size", "__source_size", "__target", "__taken"] and mixed.count() == odd.count()
    got = mixing.take(mixed, rows.columns)
    plain = mixing.take(mixing.mix(odd), odd.columns)
    assert got.columns == rows.columns and sorted(map(repr, got.select(*odd.columns).collect())) == sorted(map(repr, plain.collect()))
    assert all([r[c] for c in clash] == list(range(len(clash))) for r in got.collect())
    assert mixing.take(mixing.mix(empty), empty.columns).count() == 0


def test_quality_workers_give_memory_back(monkeypatch):
    freed = []
    monkeypatch.setattr(quality, "release", lambda: freed.append(1), raising=False)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a few words"]})
    assert [b.num_rows for b in quality._count(iter([batch, batch]), "text", ["doc_id"], "_stats")] == [1, 1] and freed == [1]
    assert not list(quality._count(iter([]), "text", ["doc_id"], "_stats")) and len(freed) == 2


def test_prefixes_of_large_groups_are_found_where_the_lines_are(spark):
    texts = [" ".join(hashlib.md5(f"{i // 2} {j}".encode()).hexdigest()[:6] for j in range(60)) for i in range(40)]
    rows = lines.stash(spark.createDataFrame([(i, x) for i, x in enumerate([*texts, *(f"{i} of one template, {'x' * 40}" for i in range(60))])], "_k long, _line string"))
    keys = rows.filter("_k % 4 < 3").select(F.col("_k").alias("_key"))
    n = keys.count()
    lists = lines.rarest(rows, keys, lines.sieve(keys, "_key", n), 9, 8, 10, n)
    got = {}
    for r in lists.collect():
        got.setdefault(r["_k"], {})[r["_pos"]] = r["_tok"]
    sets = {r["_k"]: set(r["_set"]) for r in rows.filter("_k % 4 < 3").select("_k", F.array_distinct(lines.hashes_of("_line", 9)).alias("_set")).collect()}
    times = collections.Counter(t for s in sets.values() for t in s)
    length = {k: len(s) - math.ceil(len(s) * 0.8) + 1 for k, s in sets.items()}
    assert set(got) <= set(sets) and all(set(got[k].values()) <= sets[k] and max(got[k]) < length[k] for k in got)
    # what lines that are similar need: a token in common, of those kept
    assert all(set(got[k].values()) & set(got[k + 1].values()) for k in range(0, 40, 4))
    # the rarest come first, but for tokens that share a place; tokens of one line are hardly sent
    assert all(times[got[k][0]] <= 2 for k in range(0, 40, 4)) and sum(times[t] == 1 for g in got.values() for t in g.values()) < 0.02 * sum(length.values())
    # of all tokens no rows are shuffled: lines go to tasks as texts, and only then have tokens
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "hashpartitioning(_k" in plan and "hashpartitioning(_tok" not in plan


def test_line_steps_leave_few_tables(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(lines, "drop", lambda df, real=lines.drop: gone.append(df) or real(df))
    texts = [" ".join(hashlib.md5(f"{j if (i + 7 * j) % 40 >= 7 else (i, j)}".encode()).hexdigest()[:6] for j in range(40)) for i in range(60)]
    assert classes_of(spark, [*texts, *(x + " end" for x in texts[::9])], small=2) == brute_classes([*texts, *(x + " end" for x in texts[::9])])
    assert len(gone) > 3
