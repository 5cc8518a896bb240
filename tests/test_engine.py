"""Properties: what must hold whatever the order, the batches and the levels."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import sketch
from tidelog.functions.crc import crc32c, crc32c_col
from tidelog.operators import manifest, merge, read, vlog
from tidelog.sources import files
from tidelog.sources.log import Options, validated

SCHEMA = "key bigint, value string, seq bigint"


def log(spark, n=300, keys=40, seed=1):
    r = random.Random(seed)
    return [(r.randrange(keys), r.choice(["a", "b", "", None, "x" * 150]), i) for i in range(n)]


def state(rows):
    out = {}
    for k, v, s in sorted(rows, key=lambda r: r[2]):
        out[k] = (v, s)
    return out


def got(df):
    return {r["key"]: (r["value"], r["seq"]) for r in df.collect()}


def test_latest_ignores_order_and_is_idempotent(spark):
    rows = log(spark)
    a = spark.createDataFrame(rows, SCHEMA)
    random.Random(2).shuffle(rows)
    b = spark.createDataFrame(rows, SCHEMA)
    assert got(read.latest(a)) == got(read.latest(b)) == got(read.latest(read.latest(b))) == state(rows)
    assert got(read.live(a)) == {k: v for k, v in state(rows).items() if v[0]}


def test_compaction_keeps_reads(spark):
    rows = log(spark)
    parts = [spark.createDataFrame([r for r in rows if r[2] % 3 == i], SCHEMA) for i in range(3)]
    assert got(merge.compact([merge.compact(parts[:2]), parts[2]])) == state(rows)


def test_merge_prefers_the_left_input(spark):
    a, b = (spark.createDataFrame([(k, v, 1) for k in ks], SCHEMA) for ks, v in (([1, 2], "left"), ([2, 3], "right")))
    assert {k: v[0] for k, v in got(merge.merge([a, b])).items()} == {1: "left", 2: "left", 3: "right"}
    assert {k: v[0] for k, v in got(merge.merge([a, b], reverse=True)).items()} == {1: "left", 2: "right", 3: "right"}


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "", 2), (2, "b", 1), (3, "", 1), (3, "c", 2)], SCHEMA)
    assert read.get(df, 1).count() == 0
    assert read.get(df, 3).first()["value"] == "c"
    keys = spark.createDataFrame([(1,), (2,), (9,)], "key bigint")
    assert {r["key"]: r["found"] for r in read.multi_get(df, keys).collect()} == {1: False, 2: True, 9: False}


def test_empty_key_fails(spark):
    with pytest.raises(Exception, match="empty or oversized key"):
        validated(spark.createDataFrame([("",)], "key string")).collect()


def test_separation_round_trip(spark):
    rows = [(str(k), v, s) for k, v, s in log(spark) if v]
    df = spark.createDataFrame(rows, "key string, value string, seq bigint")
    small, values = vlog.separate(df)
    back = {(r["key"], r["value"], r["seq"]) for r in vlog.dereference(small, values).collect()}
    assert back == set(rows)
    assert small.filter("meta = 1 and value is not null").count() == 0


def test_exact_rotation(spark):
    df = spark.createDataFrame([("k", "v" * 90, i, 0) for i in range(10)], "key string, value string, seq bigint, shard bigint")
    out = vlog.rotate_exactly(df, "shard", Options(vlog_size=200)).orderBy("seq").collect()
    # a record takes 97 bytes: a file ends after the one that passes 200
    assert [(r["fid"], r["offset"]) for r in out] == [(i // 3, i % 3 * 97) for i in range(10)]


def test_manifest(spark):
    m = spark.createDataFrame([(1, 7, "CREATE", 0), (2, 7, "DELETE", 0), (3, 8, "CREATE", 1), (4, 8, "CREATE", 1), (5, 9, "DELETE", 0)], "seq bigint, id bigint, op string, level int")
    assert [r["id"] for r in manifest.fold(m).collect()] == [8]
    assert {(r["seq"], r["violation"]) for r in manifest.violations(m).collect()} == {(4, "create of existing"), (5, "delete of missing")}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(1000).select(F.col("id").alias("key"))
    bits = sketch.bits_per_key(0.0125)
    n = F.lit(1000 * bits)
    built = sketch.bloom_build(keys, sketch.num_hashes(bits), n)
    probe = sketch.bloom_probe(spark.range(21000).select(F.col("id").alias("key")), built, sketch.num_hashes(bits), n)
    r = probe.agg(F.count_if((F.col("key") < 1000) & ~F.col("may_contain")).alias("missed"), F.count_if((F.col("key") >= 1000) & F.col("may_contain")).alias("wrong")).first()
    assert r["missed"] == 0 and r["wrong"] < 400


def test_crc_and_records(spark, tmp_path):
    assert crc32c(b"123456789") == 0xE3069283
    assert spark.createDataFrame([("123456789",)], "s string").select(crc32c_col("s")).first()[0] == 0xE3069283
    pairs = [(f"key{i}".encode(), b"v" * i) for i in range(200)]
    (tmp_path / "00003.vlog").write_bytes(b"".join(files.vlog_record(k, v) for k, v in pairs) + b"\x05torn")
    (tmp_path / "00004.wal").write_bytes(b"".join(files.wal_record(k, v, 9, 1) for k, v in pairs))
    v = files.read_records(spark, str(tmp_path), "vlog").orderBy("offset").collect()
    assert [(bytes(r["key"]), bytes(r["value"])) for r in v] == pairs and {r["fid"] for r in v} == {3}
    w = files.read_records(spark, str(tmp_path), "wal").collect()
    assert {(bytes(r["key"]), bytes(r["value"]), r["meta"], r["expire_at"]) for r in w} == {(k, v, 1, 9) for k, v in pairs}
    bad = bytearray(files.vlog_record(b"k", b"value"))
    bad[4] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(files.records(bytes(bad), 2))


def test_sorted_tables_prune(spark, tmp_path):
    merge.write_sorted(spark.range(5000).select(F.col("id").alias("key"), F.lit("v").alias("value")), str(tmp_path / "t"), tables=8, distinct=5000)
    t = spark.read.parquet(str(tmp_path / "t"))
    assert read.seek_ge(t, 1234).first()["key"] == 1234
    assert read.range_scan(t, 10, 20).count() == 10
    assert "EqualTo(key,77)" in t.filter("key = 77")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_stream_keeps_the_newest(spark, tmp_path):
    from tidelog.streaming import upsert

    rows = [r for r in log(spark) if r[1] is not None]
    for i in range(3):
        spark.createDataFrame(rows[(2 - i) * 100 : (3 - i) * 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    names = upsert.run_once(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "cp"), files=1)
    out = state([tuple(r) for r in spark.table(names[0]).collect()])
    assert out == state(rows)


def test_cache_replay_against_a_plain_version(spark):
    from tidelog.functions import cache

    r = random.Random(4)
    rows = [(min(int(r.expovariate(0.05)), 200), i, r.choice(["get", "get", "get", "set", "del"])) for i in range(1500)]
    got = {x["seq"]: x for x in cache.replay(spark.createDataFrame(rows, "key bigint, seq bigint, op string"), 40, shards=1).collect()}
    held: set[int] = set()
    for key, seq, op in rows:
        x = got[seq]
        assert x["hit"] == (key in held if op != "set" else False), (seq, op)
        if op == "del":
            held.discard(key)
        elif not x["hit"]:
            held.add(key)
            held.discard(x["gone"])
        assert len(held) <= 40
    assert sum(got[s]["hit"] for _, s, op in rows if op == "get") > 300


def test_cache_parts():
    from tidelog.functions import cache

    c = cache.Cache(100)
    assert (c.window_size, c.probation_size, c.protected_size) == (1, 19, 80)
    assert all(c.set(k) is None for k in range(20)) and [c.get(k) for k in (19, 3, 3, 77)] == ["window", "probation", "protected", None]
    n = cache.Counters(100)
    for _ in range(20):
        n.add(5)
    assert n.estimate(5) == 15 and n.rows.shape == (4, 128)
    n.halve()
    assert n.estimate(5) == 7


def test_valid_end_and_scan_from_an_offset(spark, tmp_path):
    one, two = files.wal_record(b"a", b"1"), files.wal_record(b"b", b"22", 9, 1)
    (tmp_path / "00003.wal").write_bytes(one + two + two[:-2])
    got = files.read_records(spark, str(tmp_path), "wal", start=len(one)).collect()
    assert [(bytes(r["key"]), r["offset"], r["expire_at"], r["fid"]) for r in got] == [(b"b", len(one), 9, 3)]
    assert [tuple(r) for r in files.valid_ends(spark, str(tmp_path), "wal").collect()] == [(3, len(one) + len(two))]


def test_varints_and_widths(spark):
    from tidelog.functions import codec

    ns = [0, 1, 127, 128, 16383, 16384, 2**31, 2**35 - 1, 2**62]
    df = spark.createDataFrame([(n,) for n in ns], "n bigint")
    out = df.select("n", codec.uvarint(F.col("n")).alias("b"), codec.fixed_bytes(F.col("n"), 8, True).alias("le"), codec.next_power(F.col("n")).alias("p"))
    for r in out.withColumn("back", codec.read_uvarint(F.col("b"))[0]).withColumn("le_back", codec.fixed_number(F.col("le"), 8, True)).collect():
        assert bytes(r["b"]) == files.uvarint(r["n"]) and r["back"] == r["n"] == r["le_back"] and bytes(r["le"]) == r["n"].to_bytes(8, "little")
        assert r["p"] == 1 << max(0, r["n"] - 1).bit_length()


def test_place_fails_over_32_bits(spark):
    big_ = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "z", 3)], "key string, value string, seq bigint")
    placed = vlog.place(big_, options=Options(vlog_size=1, vlog_entries=9)).orderBy("seq").collect()
    assert [(r["fid"], r["offset"]) for r in placed] == [(0, 0), (1, 0), (2, 0)]


def grown(d, path, tables, shift):
    """A folder with rows of ``orders`` moved on by ``shift`` keys, as larger tables have them."""
    import duckdb

    for t, key in tables.items():
        duckdb.sql(f"copy (select * replace ({key} + {shift} as {key}) from '{d}/{t}.parquet') to '{path}/{t}.parquet' (format parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["pointer_codec", "value_codec"])
@pytest.mark.parametrize("shift", [274_000, 542_000, 8_600_000, 60_000_000])
def test_codecs_equal_sql_for_large_keys(spark, sf, tmp_path, name, shift):
    import duckdb

    from tidelog.plans import registry

    # over 2^28 as expiry from key 274757 on, over 2^32 as offset from 542363 on
    d = grown(sf, tmp_path, {"orders": "o_orderkey"}, shift)
    want = duckdb.sql(f"with orders as (select * from '{d}/orders.parquet') {registry.SQL[name]}")
    df = registry.QUERIES[name](spark, d).select(*want.columns)
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_pointers_and_values_as_text(spark):
    from tidelog.functions import codec

    rows = [(7, 0, 0), (2**32 - 1, 2**32 - 1, 49), (300, 2**24, 2**31)]
    df = spark.createDataFrame(rows, "l bigint, o bigint, f bigint")
    cols = [F.col(c) for c in "lof"]
    for r in df.select("*", codec.encode_pointer(*cols).alias("b"), codec.pointer_text(*cols).alias("t")).withColumns({"x": codec.decode_pointer(F.col("b")), "y": codec.read_pointer_text(F.col("t"))}).collect():
        assert bytes(r["b"]).hex().upper() == r["t"] and tuple(r["x"]) == tuple(r["y"]) == (r["l"], r["o"], r["f"])
    ns = [0, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1]
    for r in spark.createDataFrame([(n,) for n in ns], "n bigint").select(codec.varint_text(F.col("n")).alias("t"), codec.uvarint(F.col("n")).alias("b")).collect():
        assert bytes(r["b"]).hex().upper() == r["t"]
    # four bytes can't hold it: the pointer of another place would be worse than none
    with pytest.raises(Exception, match="over 4 bytes"):
        spark.createDataFrame([(7, 2**32, 1)], "l bigint, o bigint, f bigint").select(codec.encode_pointer(*cols)).collect()


def test_bloom_probe_moves_a_row_a_key(spark, sf):
    from tidelog.plans import registry

    keys = spark.createDataFrame([(k,) for k in [*range(0, 3000, 3), 3, 3, None]], "key bigint")
    n, hashes = 9000, 6
    turned = lambda h: ((h >> 17) + (h << 15)) % 2**32
    places = lambda k: {(h + i * turned(h)) % 2**32 % n for h in [k * 2654435761 % 2**32] for i in range(hashes)}
    held = set().union(*(places(k) for k in range(0, 3000, 3)))
    words = sketch.bloom_words(keys.dropna(), hashes, F.lit(n))
    assert words.count() <= n // 64 + 1 and {r["pos"] for r in sketch.bloom_build(keys.dropna(), hashes, F.lit(n)).collect()} == held
    asked = spark.range(4000).select(F.col("id").alias("key")).unionByName(keys)
    for built in (words, sketch.bloom_build(keys.dropna(), hashes, F.lit(n))):
        got = {r["key"]: r["may_contain"] for r in sketch.bloom_probe(asked, built, hashes, F.lit(n)).collect()}
        assert got == {k: places(k) <= held for k in range(4000)} | {None: False}
    # a key's positions are not rows of one table, which a sort and a count by key would hold in memory
    plan = registry.QUERIES["bloom_probe"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == hashes


def test_cache_replay_works_out_hashes_by_batch(spark):
    import numpy as np

    from tidelog.functions import cache

    keys = np.array([0, 1, -1, 2**62, -(2**63), 77], np.int64)
    n = cache.Counters(100)
    assert n.places_of(keys) == [n.places(k) for k in keys.tolist()]
    # replayed in steps, as it was before, with every key's hashes by itself
    r = random.Random(9)
    log = [(min(int(r.expovariate(0.02)), 400), i, r.choice(["get", "get", "get", "set", "del"])) for i in range(3000)]
    one, want = cache.Cache(40), []
    for key, seq, op in log:
        part = one.get(key) if op == "get" else None
        gone = one.set(key) if op != "del" and part is None else None
        want.append((key, seq, op, one.delete(key) if op == "del" else part is not None, part, gone))
    rows = spark.createDataFrame(log, "key bigint, seq bigint, op string")
    assert sorted(map(tuple, cache.replay(rows, 40, shards=1).collect()), key=lambda x: x[1]) == want
    with pytest.raises(Exception, match="a key is missing"):
        cache.replay(spark.createDataFrame([(None, 1)], "key bigint, seq bigint"), 40).collect()
