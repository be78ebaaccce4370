import math

import pytest
from pyspark.sql import functions as F

from textindex_spark.functions import bits, hashing, wideint
from textindex_spark.operators import dynamic, predecessor, sketch, succinct
from textindex_spark.plans import config, phases
from textindex_spark.sources import files, random


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_codes(spark):
    x = lambda v: F.lit(v).cast("bigint")
    got = one(spark, bits.gamma_code(x(1)), bits.gamma_code(x(5)), bits.delta_code(x(1)), bits.delta_code(x(5)), bits.rice_code(x(9), 2), bits.gamma_code(x(0)), bits.delta0_code(x(0)), bits.unary_code(x(3)))
    assert got == ["1", "00101", "1", "01101", "01101", None, "1", "0001"]


def test_edges_of_bit_functions(spark):
    got = one(spark, bits.bit_mask(0), bits.bit_mask(64), bits.bit_mask(40), bits.isqrt_floor(F.lit((1 << 60) - 1)), bits.isqrt_ceil(F.lit((1 << 60) - 1)), bits.tzcnt(F.lit(0).cast("bigint")), bits.lzcnt(F.lit(0).cast("bigint")), bits.select1_u64(F.lit(0).cast("bigint"), 1))
    assert got == [0, -1, (1 << 40) - 1, (1 << 30) - 1, 1 << 30, 64, 64, None]


def test_pack_bits(spark):
    assert one(spark, bits.pack_bits(F.lit("10110")), bits.pack_bits(F.lit("")), bits.pack_bits(F.lit("1111000011"))) == [bytes([0b10110000]), b"", bytes([0xF0, 0xC0])]


def test_primes(spark):
    got = [r[0] for r in random.primes(spark, 0, 30).orderBy("value").collect()]
    assert got == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]


def test_hash_check_values(spark):
    got = one(spark, hashing.crc32(F.encode(F.lit("123456789"), "UTF-8")), hashing.fnv1a(hashing.bytes_of(F.lit(""))))
    assert got == [3421780262, 2166136261]


@pytest.mark.parametrize("w", [8, 16, 32, 64, 128])
def test_rolling_fingerprint_comes_back(spark, w):
    symbols = [97 + i % 26 for i in range(w)]
    first = one(spark, hashing.karp_rabin(F.array(*[F.lit(s).cast("bigint") for s in symbols])))[0]
    steps = F.array(*[F.lit(s).cast("bigint") for s in symbols])
    rolled = one(spark, F.aggregate(steps, F.lit(first).cast("bigint"), lambda fp, s: hashing.roll(fp, s, s, w)))[0]
    assert rolled == first


def test_wide_integers(spark):
    for n in wideint.WIDTHS:
        a, b = (1 << n) - 3, (1 << (n // 2)) + 12345
        lit = lambda v: F.lit(v.to_bytes(n // 8, "big"))  # noqa: E731,B023
        for op, want in (("add", (a + b) % (1 << n)), ("sub", (b - a) % (1 << n)), ("mul", a * b % (1 << n)), ("div", a // b), ("mod", a % b), ("xor", a ^ b)):
            x, y = (lit(b), lit(a)) if op == "sub" else (lit(a), lit(b))
            assert int.from_bytes(one(spark, wideint.wide(op, x, y, n))[0], "big") == want
        assert one(spark, wideint.wide("div", lit(a), lit(0), n)) == [None]
    assert one(spark, wideint.print_uint(F.lit((255).to_bytes(16, "big")), 8), wideint.print_uint(F.lit((255).to_bytes(16, "big")), 16)) == ["377", "ff"]


def test_big_floats(spark):
    import math

    got = one(spark, wideint.bigfloat("sqrt", F.lit("2")), wideint.bigfloat("div", F.lit("1"), F.lit("0")), wideint.bigfloat("pi", F.lit("0"), digits=30), wideint.bigfloat("lgamma", F.lit("10.5")), wideint.bigfloat("floor", F.lit("-1.5")))
    assert got[0].startswith("1.41421356237309504880168872420969807856967187537") and got[1] is None
    assert got[2] == "3.14159265358979323846264338328"
    assert abs(float(got[3]) - math.lgamma(10.5)) < 1e-12 and got[4] == "-2"


@pytest.mark.parametrize("shift", [0, 2, 10])
def test_predecessor_at_edges(spark, shift):
    keys = spark.createDataFrame([(k,) for k in (3, 3, 8, 100, None, -5)], "k long")
    asked = spark.createDataFrame([(v,) for v in (-6, -5, 0, 3, 7, 8, 99, 100, 1000, None)], "x long")
    want = {-6: (None, None, -5), -5: (-5, 0, -5), 0: (-5, 0, 3), 3: (3, 1, 3), 7: (3, 1, 8), 8: (8, 2, 8), 99: (8, 2, 100), 100: (100, 3, 100), 1000: (100, 3, None), None: (None, None, None)}
    for df in (predecessor.search(asked, keys, "x", "k", shift=shift), predecessor.search_windowed(asked, keys, "x", "k", []), predecessor.search_broadcast(asked, keys, "x", "k")):
        assert {r.x: (r.pred, r.pos, r.succ) for r in df.collect()} == want
    none = keys.where("k > 1000")
    assert {r.pred for r in predecessor.search(asked, none, "x", "k").collect()} == {None}
    assert predecessor.search(asked.limit(0), keys, "x", "k").count() == 0


def test_op_replay(spark):
    ops = spark.createDataFrame([(0, "I", 5), (1, "I", 9), (2, "Q", 8), (3, "D", 5), (4, "Q", 8), (5, "Q", 10)], "op_seq long, opcode string, key long")
    asked = ops.where("opcode = 'Q'").select("op_seq", F.col("key").alias("x"))
    for shift in (1, 2, 8):
        got = {r.op_seq: r.answer for r in dynamic.nearest(asked, dynamic.intervals(ops), "x", "op_seq", shift).collect()}
        assert got == {2: 5, 4: None, 5: 9}


def test_nearest_goes_up_levels(spark, monkeypatch):
    monkeypatch.setattr(dynamic, "BROADCAST_SPANS", 3)
    ops = spark.createDataFrame([(i, "I", 37 * i % 1000) for i in range(60)] + [(100, "Q", 999), (101, "Q", 0), (102, "Q", 500)], "op_seq long, opcode string, key long")
    asked = ops.where("opcode = 'Q'").select("op_seq", F.col("key").alias("x"))
    keys = {37 * i % 1000 for i in range(60)}
    got = {r.x: r.answer for r in dynamic.nearest(asked, dynamic.intervals(ops), "x", "op_seq", 3).collect()}
    assert got == {x: max((k for k in keys if k <= x), default=None) for x in (999, 0, 500)}


def test_running_minimum(spark):
    steps = [("I", k) for k in range(100, 0, -1)] + [("I", 101), ("D", 101)] + [("D", k) for k in range(1, 100)] + [("D", 100)]
    ops = spark.createDataFrame([(i, c, k) for i, (c, k) in enumerate(steps)], "op_seq long, opcode string, key long")
    got = [r.min_key for r in dynamic.extremes_over_time(ops).orderBy("op_seq").collect()]
    assert got == [*range(100, 0, -1), 1, 1, *range(2, 101), None]


def test_vectors(spark):
    d = spark.createDataFrame(enumerate([147, 666, 1337, 65535, 65536 + 7]), "i long, value long")
    assert [r[0] for r in d.select(succinct.masked(F.col("value"), 16)).collect()] == [147, 666, 1337, 65535, 7]


def test_minimum_and_sketch():
    m = sketch.Minimum()
    for item, n in (("a", 3), ("b", 1), ("c", 2)):
        m.insert(item, n)
    m.increase("b")
    assert m.minimum()[1] == 2
    m.increase("b")
    assert m.extract_min() == ("c", 2) and m.minimum()[1] == 3
    s = sketch.AugmentedSketch(4, 64, 2)
    truth = {}
    for i in range(4000):
        key = 7 if i % 3 == 0 else i % 501
        truth[key] = truth.get(key, 0) + 1
        s.count(key, i)
    found = s.frequent()
    assert found[0][0] == 7 and all(n >= truth[k] for k, n, _ in found if k == 7)


def test_document_hashes(spark, sf_dir):
    import zlib

    from textindex_spark.plans.catalog import QUERIES

    got = {r.doc_id: r for r in QUERIES["document_hashes"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        fnv, fp = 2166136261, 0
        for b in text.encode():
            fnv = (fnv ^ b) * 16777619 & 0xFFFFFFFF
            fp = (fp * hashing.ROLLING_BASE + b) % ((1 << 61) - 1)
        assert (got[doc_id].crc, got[doc_id].fnv, got[doc_id].fingerprint) == (zlib.crc32(text.encode()), fnv, fp)


def test_gram_hash(spark):
    p = (1 << 62) - 273
    assert one(spark, hashing.gram_hash(0), hashing.gram_hash(1), hashing.gram_hash(2), hashing.gram_hash(-1), hashing.gram_hash((1 << 33) + 1)) == [0, ((1 << 64) - 1) % p, 0xAAAAAAAAAAAAAAAA % p, ((1 << 64) - 1) % p, (1 << 33) + 1]


def test_permutation_is_one(spark):
    for u in (3, 10, 1000, 4099):
        got = [r.value for r in random.permutation(spark, u).collect()]
        assert sorted(got) == list(range(u))


def test_permutation_follows_its_definition(spark):
    masks, wrap = 0x9696594B6A5936B2 ^ 0xD2165B4B66592AD6, (1 << 64) - 1
    for u, p, seed in ((1000, 991, 147), (1000, 991, masks ^ wrap), ((1 << 16) - 1, (1 << 16) - 17, 5)):

        def residue(x):
            return x if x >= p else x * x % p if x <= p // 2 else p - x * x % p

        want = [residue(((seed ^ masks) + residue(i) & wrap) % u) for i in range(u)]
        assert [r.value for r in random.permutation(spark, u, seed).orderBy("i").collect()] == want


def test_generated_operations_are_valid():
    live = set()
    for code, keys in random.generate_operations(1, 50, 1 << 16, 5):
        if code == "I":
            assert live.isdisjoint(keys) and len(set(keys)) == len(keys)
            live |= set(keys)
        elif code == "D":
            assert live >= set(keys)
            live -= set(keys)
    assert not live


def test_files(spark, tmp_path):
    (tmp_path / "n.bin").write_bytes(b"".join(i.to_bytes(8, "little") for i in range(1, 9)) + b"xyz")
    assert [(r.i, r.value) for r in files.read_integers(spark, str(tmp_path / "n.bin")).orderBy("i").collect()] == [(i, i + 1) for i in range(8)]
    (tmp_path / "five.bin").write_bytes((1 << 39).to_bytes(5, "little"))
    assert files.read_integers(spark, str(tmp_path / "five.bin"), 5).first().value == 1 << 39
    (tmp_path / "l.txt").write_text("12\n\n7\n")
    assert sorted(r.value for r in files.read_integer_lines(spark, str(tmp_path / "l.txt")).collect()) == [7, 12]
    batches = [("I", [5, 9]), ("Q", [8]), ("D", [5])]
    (tmp_path / "ops.bin").write_bytes(files.encode_operations(batches, 1 << 32))
    got = [(r.op_seq, r.batch, r.opcode, r.key) for r in files.read_operations(spark, str(tmp_path / "ops.bin")).orderBy("op_seq").collect()]
    assert got == [(0, 0, "I", 5), (1, 0, "I", 9), (2, 1, "Q", 8), (3, 2, "D", 5)]
    lines = spark.createDataFrame([("RESULT algo=x n=1 t=4",), ("noise",), ("RESULT algo=x n=3 t=8",), ("RESULT algo=y n=5 t=1",)], "value string")
    table = files.result_table(lines, "algo", ["n", "t"], "median")
    files.write_csv(table.coalesce(1), str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "out")).collect())) == [("x", "2.0", "6.0"), ("y", "5.0", "1.0")]
    files.write_nothing(table)


def test_command_line():
    got = config.parse_command_line("-x --obj=A --obj.a=100 --obj.b=str in1 in2 --l=1 --l=2".split())
    assert got == {"x": True, "obj": {"__name": "A", "a": "100", "b": "str"}, "l": ["1", "2"], "__args": ["in1", "in2"]}
    c = config.Config(got)
    assert c.flag("x") and c.sub("obj").integer("a") == 100 and c.string("obj") == "A" and c.strings("l") == ["1", "2"]
    assert config.Config({"s": "4Ki"}).bytes("s") == 4096 and config.Config({"s": "2k"}).bytes("s") == 2000 and config.Config({"s": "4x"}).integer("s", 3) == 3


def test_registry_of_24():
    def part(n):
        return type(n, (config.Algorithm,), {"name": n})

    refs, chars, tries = [part("Delta0"), part("Binary")], [part("Rice"), part("Huff"), part("Plain")], [part("FIFO"), part("MTF")]
    codes = config.instances(lambda layout, r, c: type("code", (config.Algorithm,), {"name": layout, "slots": {"ref": r, "char": c}}), ["Tuples", "Arrays"], refs, chars)
    kinds = config.instances(lambda c, t: type("lz78", (config.Executable,), {"name": "lz78", "slots": {"code": c, "trie": t}, "execute": lambda self, df: df}), codes, tries)
    registry = config.Registry()
    registry.register(*kinds)
    assert len(kinds) == 24
    chosen = registry.resolve("--code=Arrays --code.ref=Binary --code.char=Huff --trie=MTF in".split())
    assert (chosen.code.name, chosen.code.ref.name, chosen.code.char.name, chosen.trie.name) == ("Arrays", "Binary", "Huff", "MTF")
    with pytest.raises(LookupError):
        registry.resolve(["--code=Other"])


def test_phases():
    with phases.Phase("outer") as p:
        with phases.Phase("inner") as q:
            phases.Phase.log_current("n", 3)
        with p.suppress(), phases.Phase("hidden"):
            pass
    tree = p.to_json()
    assert [s["title"] for s in tree["sub"]] == ["inner"] and q.data == {"n": 3}
    assert p.to_keyval().startswith("RESULT title=outer time=")


def test_stream_replay(spark, tmp_path):
    from textindex_spark.streaming.replay import replay, run_available

    ops = [(0, "I", 5), (1, "I", 9), (2, "Q", 8), (3, "D", 5), (4, "Q", 8), (5, "Q", 10), (6, "I", -30), (7, "Q", -5), (8, "Q", 5), (9, "Q", -31)]
    spark.createDataFrame(ops, "op_seq long, opcode string, key long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("op_seq long, opcode string, key long").parquet(str(tmp_path / "in"))
    want = {2: (5, 9, 2), 4: (None, 9, 1), 5: (9, None, 1), 7: (-30, 9, 2), 8: (-30, 9, 2), 9: (None, -30, 2)}
    for name, universe in (("few", (3, -32, 31)), ("all", ())):
        got = run_available(stream, str(tmp_path / name), *universe)
        assert {r.op_seq: (r.pred, r.succ, r.size) for r in got.collect()} == want
    with pytest.raises(ValueError, match="larger shift"):
        replay(stream, 3)


def test_extremes_over_time_by_brute_force(spark):
    import random

    rng = random.Random(4)
    live, rows, want, seq = set(), [], {}, 1000
    for _ in range(400):
        k = rng.randrange(-20, 20)
        code = "D" if k in live and rng.random() < 0.7 else "I"
        rows.append((seq, code, k))
        before = len(live)
        live = live | {k} if code == "I" else live - {k}
        if len(live) != before:
            want[seq] = (len(live), min(live, default=None), max(live, default=None))
        seq += rng.randint(1, 9)
    ops = spark.createDataFrame(rows, "op_seq long, opcode string, key long")
    for top in (15, 2):
        dynamic.TOP_LEVELS = top
        assert {r.op_seq: (r.size, r.min_key, r.max_key) for r in dynamic.extremes_over_time(ops).collect()} == want
    dynamic.TOP_LEVELS = 15
    assert dynamic.extremes_over_time(ops.limit(0)).count() == 0


def test_search_bears_clashing_names(spark, monkeypatch):
    names = ("_q", "_v", "v", "bucket", "asked", "row", "p", "s", "b0", "k")
    q = spark.createDataFrame([(7, 1), (2, 1), (None, 1)], "x long, g long")
    for n in names:
        q = q.withColumn(n, F.lit(3))
    keys = spark.createDataFrame([(3, 1), (9, 1), (3, 1), (None, 1)], "k long, g long")
    want = {(7, 3, 0, 9, 3), (2, None, None, 3, 3), (None, None, None, None, 3)}
    found = lambda d: {(r.x, r.pred, r.pos, r.succ, r._v) for r in d.collect()}
    assert found(predecessor.search(q, keys, "x", "k", ["g"], shift=1)) == found(predecessor.search_windowed(q, keys, "x", "k", ["g"])) == want
    assert found(predecessor.search_broadcast(q, keys, "x", "k")) == want
    monkeypatch.setattr(predecessor, "BROADCAST_KEYS", 1)
    assert found(predecessor.search_broadcast(q, keys, "x", "k")) == want
    assert [r.x for r in predecessor.contains(q.withColumn("x", F.col("x") + 2), keys, "x", "k").collect()] == [9]


def test_roots_and_primes_at_the_edges(spark):
    values = [0, 1, 2, 3, 4, 8, 9, (1 << 62) - 1, 1 << 62, 3037000499**2, 3037000499**2 - 1, (1 << 63) - 1]
    d = spark.createDataFrame([(v,) for v in values], "v long")
    got = {r.v: (r.f, r.c) for r in d.select("v", bits.isqrt_floor(F.col("v")).alias("f"), bits.isqrt_ceil(F.col("v")).alias("c")).collect()}
    assert got == {v: (math.isqrt(v), math.isqrt(v - 1) + 1 if v else 0) for v in values}
    # the primes around a gap of 354, and the smallest ones
    d = spark.createDataFrame([(4302407360,), (4302407712,), (4302407713,), (0,), (2,), (14,)], "v long")
    got = {r.v: (r.p, r.s) for r in d.select("v", bits.prime_predecessor(F.col("v")).alias("p"), bits.prime_successor(F.col("v")).alias("s")).collect()}
    assert got == {4302407360: (4302407359, 4302407713), 4302407712: (4302407359, 4302407713), 4302407713: (4302407713, 4302407713), 0: (None, 2), 2: (2, 2), 14: (13, 17)}
    codes = spark.createDataFrame([(1,), (2,), (5,), (17,), ((1 << 63) - 1,)], "v long").select("v", bits.gamma_code(F.col("v")).alias("g"), bits.delta_code(F.col("v")).alias("d")).collect()
    assert {r.v: r.g for r in codes}[5] == "00101" and {r.v: r.d for r in codes}[17] == "001010001" and {r.v: r.d for r in codes}[1] == "1"
    assert all(r.g == "0" * (r.v.bit_length() - 1) + f"{r.v:b}" for r in codes)


def test_table_functions(spark):
    from textindex_spark.plans.sql import register

    assert "lz77" in register(spark)
    spark.createDataFrame([(1, "abab"), (2, ""), (3, None)], "doc_id long, text string").createOrReplaceTempView("some_docs")
    got = spark.sql("SELECT d.doc_id, f.* FROM some_docs d, LATERAL lz77(d.text) f ORDER BY doc_id, seq").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, None, 0, 97), (1, 1, 1, None, 0, 98), (1, 2, 2, 0, 2, None)]
    got = spark.sql("SELECT f.* FROM some_docs d, LATERAL lz78(d.text) f WHERE doc_id = 1 ORDER BY seq").collect()
    assert [tuple(r) for r in got] == [(0, 0, 97), (1, 0, 98), (2, 1, 98)]


def test_tee_and_order(spark):
    from textindex_spark.operators import factorize, factors

    docs = spark.createDataFrame([(1, "abababab")], "doc_id long, text string")
    stats, text = factors.tee(factorize.factorize(docs), factors.stats, factors.decode)
    assert stats.first().num_refs == 1 and bytes(text.first().content) == b"abababab"
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 9)], "v long, i long, k long")
    assert succinct.assert_ascending(rows, "v", "i", "k").count() == 3
    with pytest.raises(Exception, match="ascending"):
        succinct.assert_ascending(rows.withColumn("k", -F.col("k")), "v", "i", "k").collect()
