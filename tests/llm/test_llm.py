import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textindex_spark.llm import chat, decontamination, html_extract, jaccard_join, licences, packing, quality_model, quality_rules, token_store, toxicity
from textindex_spark.llm.common import materialize, read_table
from textindex_spark.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(name, agree):
    agree(QUERIES[name], ORACLES[name])


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that operators must bear: nulls, empty and long texts, repeated rows, and columns of clashing names."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one two three", "en", None, 13), (4, "one two three", "en", None, 13),
        (None, "four five six seven eight nine ten", None, "b", 1), (5, "word " * 30000, "en", "b", 150000), (6, "é😀 <|end|> </s>[INST]", "xx", "c", 5),
    ]
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumn("label", F.lit("x")).withColumn("key", F.lit(1)).withColumn("h", F.lit(2)).withColumn("words", F.lit(3)).withColumn("bucket", F.lit(4)).withColumn("rep", F.lit(5)).withColumn("shard", F.lit(6))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, 1, 0), (4, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_packing_bears_odd_rows(odd):
    got = packing.pack_documents(odd, 2048).collect()
    assert sum(r.length for r in got) == 3 * 2 + 7 + 30000 + 3
    assert len([r for r in got if r.doc_id == 4]) == 2 and len({(r.shard, r.bin) for r in got if r.doc_id == 4}) == 2
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_best_fit_against_brute_force():
    def brute(lengths, sources, clusters, cap):
        bins, out = [], []
        for n, s, c in zip(lengths, sources, clusters):
            fit = [(b[0], i) for i, b in enumerate(bins) if b[0] >= n and not (s >= 0 and s in b[1]) and not (c >= 0 and c in b[2])]
            if fit:
                i = min(fit)[1]
            else:
                bins.append([cap, set(), set()])
                i = len(bins) - 1
            out.append((i, cap - bins[i][0]))
            bins[i][0] -= n
            bins[i][1].update([s] * (s >= 0))
            bins[i][2].update([c] * (c >= 0))
        return out

    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(0, 80)
        lengths, sources, clusters = sorted((rng.randint(0, 50) for _ in range(n)), reverse=True), [rng.randint(-1, 6) for _ in range(n)], [rng.choice([-1, -1, 0, 1, 2]) for _ in range(n)]
        bins, offsets, _ = packing.pack_shard(lengths, sources, clusters, 50)
        assert list(zip(bins, offsets)) == brute(lengths, sources, clusters, 50)


def test_packing_query_has_no_conflicts(spark, sf_dir):
    got = QUERIES["op1_packing"](spark, sf_dir).toPandas()
    docs = read_table(spark, sf_dir, "documents").toPandas()
    m = got.merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert m.groupby(["shard", "bin"])["length"].sum().max() <= packing.CAPACITY
    assert not m.duplicated(["shard", "bin", "source"]).any() and not m.duplicated(["shard", "bin", "text"]).any()
    assert m["length"].sum() == docs["text"].str.split().str.len().sum()


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_packing_query_keeps_near_copies_apart(spark, sf_dir, odd):
    got = QUERIES["op1_packing"](spark, sf_dir).toPandas()
    text = {r.doc_id: shingle_set(r.text) for r in read_table(spark, sf_dir, "documents").collect()}
    for _, ids in got.groupby(["shard", "bin"])["doc_id"]:
        ids = sorted(set(ids))
        for k, a in enumerate(ids):
            assert not any(text[a] and len(text[a] & text[b]) >= 0.8 * len(text[a] | text[b]) for b in ids[k + 1 :])
    base = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:-1], f"end{i}"]), "en", f"source{i}", 0) for i in range(12)]
    rows += [(100 + i, " ".join(f"other{i}x{j}" for j in range(60)), "en", f"source{i + 50}", 0) for i in range(12)]
    near = packing.pack(packing.near_copies(spark.createDataFrame(rows, DOCS))).toPandas()
    copies = near[near["doc_id"] < 100]
    assert not copies.duplicated(["shard", "bin"]).any()
    # the others join the bins of the copies
    assert near.groupby(["shard", "bin"]).ngroups == 12
    assert packing.pack(packing.near_copies(odd)).agg(F.sum("length")).first()[0] == 3 * 2 + 7 + 30000 + 3
    assert packing.pack(packing.near_copies(odd.limit(0))).count() == 0


def test_control_bytes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        r = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_store.encode_ranks(r)
        assert (token_store.decode_ranks(control, data, n) == r).all()
        assert len(control) == -(-n // 4)


def test_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_store.default_tokenizer())
    whole.encode_special_tokens = True
    rng = random.Random(4)
    letters = [" ", "  ", "\n", "\t", "a", "b", "é", "1", "2", ".", "!", "'s", "'", " ", "　", "\r", " \n", "😀", "の", "x ", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    encoder = token_store.Encoder(token_store.default_tokenizer(), 500)
    got = [x for a in range(0, len(texts), 50) for x in encoder.encode(texts[a : a + 50])]
    assert got == [np.array(e.ids, dtype="<u2").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_token_store_query_by_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_store.default_tokenizer())
    got = QUERIES["op2_token_store"](spark, sf_dir).toPandas().sort_values("doc_id")
    start = 0
    for d, r in zip(read_table(spark, sf_dir, "documents").orderBy("doc_id").collect(), got.itertuples()):
        ids = [*whole.encode(d.text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_token_store_bears_odd_rows(spark, odd, tmp_path):
    token_store.write_store(odd, token_store.default_tokenizer(), f"file://{tmp_path}/s")
    got = token_store.read_store(spark, f"file://{tmp_path}/s").orderBy("start").collect()
    assert len(got) == odd.count() and [r.n_tokens for r in got if r.doc_id in (1, 2)] == [1, 1] and got[0].doc_id is None
    token_store.write_store(odd.limit(0), token_store.default_tokenizer(), f"file://{tmp_path}/e")
    assert token_store.read_store(spark, f"file://{tmp_path}/e").count() == 0


def test_chat_escape_is_reversible():
    rng = random.Random(3)
    for _ in range(3000):
        x = "".join(rng.choice(["<", "|", "\\", "turn", ">", "a"]) for _ in range(rng.randint(0, 9)))
        assert chat.unescape(chat.escape(x)) == x and "<|" not in chat.escape(x)


def test_chat_query_by_brute_force(spark, sf_dir):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    turns = {}
    for r in read_table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = QUERIES["op3_chat"](spark, sf_dir).collect()
    assert {r.conv_id for r in got} == set(turns)
    for r in got:
        loss = "".join(t for role, t in turns[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns[r.conv_id]), sha("".join(f"{a}\n{b}\n" for a, b in turns[r.conv_id])), len(loss), sha(loss))


def test_chat_bears_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (1, 2, "assistant", ""), (1, 3, "assistant", " <|end|> é😀\n\n"), (None, None, "assistant", "a"), (2, 0, "system", "y" * 200000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).withColumn("formatted", F.lit(""))
    out = {r.conv_id: r for r in chat.format_chats(d, token_store.default_tokenizer()).collect()}
    assert chat.parse(out[1].formatted) == [("user", ""), ("", "x"), ("", "x"), ("assistant", ""), ("assistant", " <|end|> é😀\n\n")]
    assert "".join(chat.unescape(out[1].formatted[a:b]) for a, b in zip(out[1].loss_starts, out[1].loss_ends)) == " <|end|> é😀\n\n"
    assert set(out) == {1, 2, None} and len(out[2].formatted) > 200000
    assert chat.format_chats(d.limit(0), token_store.default_tokenizer()).count() == 0


def test_segments_against_brute_force():
    def brute(s, a, b):
        best = None
        for i in range(a, b):
            t = 0
            for j in range(i, b):
                t += s[j]
                if t > 0 and (best is None or t > best[0] + 1e-9):
                    best = (t, i, j + 1)
        return [] if best is None else [*brute(s, a, best[1]), best[1:], *brute(s, best[2], b)]

    rng = random.Random(8)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 7 for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute(s, 0, len(s))


def test_toxic_passages_are_all_found_and_repeats_saturate():
    model = toxicity.Model({"vile": 9.5, "scum": 8.5, "kind": -4.0}, 1.0, 0.1, 1.0, 0.0)
    plain = ["so"] * 200
    passage = ["vile", "scum", "vile"]
    found, whole = model.scan(["vile", *plain, *passage, *plain, *passage], {})
    assert [(a, b) for a, b, _ in found] == [(0, 1), (201, 204), (404, 407)]
    evidence = lambda n: model.scan(["vile"] * n + plain[: 100 - n], {})[1]
    assert 0 < evidence(1) < evidence(2) < evidence(40) < 5 * (evidence(1) + 3)
    assert whole > model.scan([*passage, *plain, *plain], {})[1]
    assert [(a, b) for a, b, _ in model.scan(["vile", *["kind"] * 3, "vile"], {})[0]] == [(0, 1), (4, 5)]
    assert model.scan(["mild"], {}) == ([], 0.0) and model.scan([], {}) == ([], 0.0)


def test_log_odds_by_hand():
    p, whole = toxicity.PRIOR, 0.1
    odds = toxicity.log_odds({"mildly": (60, 5), "mildl*": (90, 5), "calm": (0, 60), "flat": (10, 90), "rare": (2, 0)}, 100, 900)
    prefix = (30 + p * whole) / (30 + p)
    share = (60 + p * prefix) / (65 + p)
    assert set(odds) == {"mildly", "mildl*", "calm", "flat"} and odds["mildly"] == pytest.approx(np.log(share / (1 - share)) - np.log(1 / 9))
    # zero counts count, on either side
    share = p * whole / (60 + p)
    assert odds["calm"] == pytest.approx(np.log(share / (1 - share)) - np.log(1 / 9)) and odds["flat"] == pytest.approx(0)


def test_extreme_values_against_theory():
    """For independent scores lambda is the positive root of E exp(lambda s) = 1, and the fit has the right tail."""
    rng = np.random.default_rng(3)
    values, p = np.array([-1.0, -0.3, 1.1, 2.0]), np.array([0.5, 0.35, 0.1, 0.05])
    lo, hi = 0.01, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * values)).sum() < 1 else (lo, mid)
    lengths = rng.integers(300, 3000, 1500)
    highest = [(int(n), toxicity.rise(rng.choice(values, n, p=p))) for n in lengths]
    lam, k = toxicity.extreme_values(highest)
    assert lam == pytest.approx(lo, rel=0.08)
    over = lambda q: np.mean([k * n * np.exp(-lam * s) < q for n, s in highest])
    assert over(0.1) == pytest.approx(1 - np.exp(-0.1), abs=0.03) and over(1.0) == pytest.approx(1 - np.exp(-1.0), abs=0.05)
    assert toxicity.extreme_values([]) == (1.0, 1.0)


def test_chance_segments_are_rejected_and_toxic_documents_found(spark, fixture_dir):
    docs, labels = read_table(spark, fixture_dir, "documents"), read_table(spark, fixture_dir, "labels")
    model = toxicity.fit(docs, labels)
    held = docs.join(labels.where("crc32(cast(doc_id as string)) % 3 = 1"), "doc_id").select("text", "toxic").collect()
    memory, positive, significant, right = {}, 0, 0, Counter()
    for text, toxic in held:
        words = toxicity.WORD.findall((text or "").lower())
        found, evidence = model.scan(words, memory)
        right[toxic, model.score(evidence) >= toxicity.THRESHOLD] += 1
        if not toxic:
            positive += len(toxicity.segments(model.values(words, memory).tolist()))
            significant += len(found)
    assert significant < 0.01 * positive
    # recall and precision
    assert right[1, True] >= 0.9 * (right[1, True] + right[1, False]) and right[1, True] >= 0.97 * (right[1, True] + right[0, True])


@pytest.fixture(scope="module")
def fixture_dir():
    return "/root/testdata/sf0.1"


@pytest.mark.parametrize("name, label, least", [("op4_toxicity", "toxic", 0.97), ("op8_quality", "quality", 0.99)])
def test_held_out_accuracy(name, label, least, spark, fixture_dir):
    got = QUERIES[name](spark, fixture_dir).toPandas()
    assert got["score"].between(0, 1).all() and len(got) == read_table(spark, fixture_dir, "documents").count()
    held = got.merge(read_table(spark, fixture_dir, "labels").toPandas(), on="doc_id")
    held = held[held["held_out"]]
    assert (held["predicted"] == held[label]).mean() >= least
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got["doc_id"], got["held_out"]))


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_model, "quality")])
def test_classifiers_bear_odd_rows(module, label, odd, labels):
    model = module.fit(odd, labels)
    assert module.score(odd, model).count() == odd.count()
    assert all(0 <= r.score <= 1 for r in module.score(odd, model).collect())
    assert module.keep(odd, model).columns == odd.columns
    assert module.score(odd.limit(0), module.fit(odd.limit(0), labels)).count() == 0
    assert module.score(odd, module.fit(odd, labels.limit(0))).count() == odd.count()


def test_pool_violators():
    x, y = np.array([1, 2, 3, 4, 5.0]), np.array([0, 1, 0, 1, 1.0])
    knots, values = quality_model.pool_violators(x, y)
    assert np.interp(x, knots, values).tolist() == [0, 0.5, 0.5, 1, 1]


def test_licences():
    model = licences.train([])
    family = lambda s: (model.judge(s) or (None,))[0]
    assert family("Released under the MIT License.") == "MIT" and family("Licensed under CC BY-NC 4.0.") == "CC-BY-NC" and family("All rights reserved.") == "Proprietary"
    assert family("LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.!!") == "Apache-2.0" and family("Licensed under the Zork Framework License 4.") == licences.UNKNOWN
    assert family("Der mit und die.") is None and family("the copyright law was debated in parliament for many years and years") is None and family("") is None


def test_licences_score_every_paragraph():
    model = licences.train(["Der Hund ging mit der Frau.", "It was a public matter of common attribution in the domain of the crown."])
    family = lambda s: (model.judge(s) or (None,))[0]
    assert [(f, t) for f, t in licences.notices() if family(t) != f] == []
    wanted = {"Released under the Creative Commons Zero.": "CC0", "Available under the public domain dedication.": "CC0", "Released under Apache 2.0.": "Apache-2.0", "LGPLv2 or later": "LGPL", "CC-SA": "CC-BY-SA", "Todos los derechos reservados.": "Proprietary", "Lizenziert unter der MIT License.": "MIT"}
    assert {t: family(t) for t in wanted} == wanted
    assert family("Der mit.") is None and family("Public matter.") is None


def test_licence_query_by_brute_force(spark, sf_dir):
    notices = {"This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    want = {(d.doc_id, k, notices[line]) for d in read_table(spark, sf_dir, "documents").collect() for k, line in enumerate((d.text or "").split("\n")) if line in notices}
    got = QUERIES["op5_licences"](spark, sf_dir).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got if r.confirmed} == want and all(r.confirmed for r in got)


def test_licences_bear_odd_rows(odd):
    model = licences.fit(odd)
    assert licences.scan(odd, model).count() == 0 and licences.scan(odd.limit(0), licences.fit(odd.limit(0))).count() == 0


def brute_links(rows):
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            c = len(x & y)
            if c and c * 10 >= 8 * (len(x) + len(y) - c):
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(i, least.get(find(n), i))
    return {i: (least[find(n)], links[n]) for n, (i, _) in enumerate(sets)}


@pytest.mark.parametrize("block", [16, 2048])
def test_jaccard_join_by_brute_force(block, spark, sf_dir, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf_dir, "documents").collect()]
    rng, k = random.Random(1), 100000
    for _, text in [r for r in rows if 80 < len((r[1] or "").split()) < 300][:2]:
        for _ in range(40):
            w = text.split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = str(rng.randint(0, 99))
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "a b"), (k + 4, "A  b"), (k + 5, "a b c")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)


def test_jaccard_join_bears_odd_rows(spark, odd):
    assert jaccard_join.join(odd).count() == odd.count()
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.count() == odd.count() - 1
    assert jaccard_join.join(odd.limit(0)).count() == 0 and jaccard_join.keep_one(odd.limit(0)).count() == 0
    clash = odd.withColumn("_gone", F.lit(1)).withColumn("_twice", F.lit(1)).withColumn("n", F.lit(1)).withColumn("first", F.lit(1)).withColumn("rep", F.lit(1)).withColumn("root", F.lit(1))
    assert jaccard_join.keep_one(clash).columns == clash.columns and jaccard_join.keep_one(clash).count() == odd.count() - 1
    texts = spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(texts).collect())) == [(1, 1, 0), (2, 2, 0)]


def test_jaccard_join_of_an_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [(5, a), (5, b), (7, a.replace("a50", "x")), (8, b.replace("b50", "x")), (9, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(docs).collect())) == [(5, 5, 1), (5, 5, 2), (7, 5, 2), (8, 5, 1), (9, 5, 2)]
    assert sorted(map(tuple, jaccard_join.keep_one(docs).collect())) == [(5, a), (5, b)]


def test_words_of_all_lengths_have_hashes_of_their_own():
    j = jaccard_join
    words = [b"a" * n for n in range(1, 140)] + [b"a" * n + b"\0" for n in range(1, 140)] + ["\u00e9\u4e2d".encode() * 9, b"b" * 63, b"b" * 64, b"b" * 65]
    h, offsets = j.word_hashes([b" ".join(words), b"a", b" ".join(reversed(words))])
    assert offsets.tolist() == [0, len(words), len(words) + 1, 2 * len(words) + 1]
    assert len(set(h.tolist())) == len(words) and h[len(words)] == h[0] and h[len(words) + 1 :][::-1].tolist() == h[: len(words)].tolist()
    rng = random.Random(4)
    for text in [None, "", " \n\t", *("".join(rng.choice("aB\u0130 \t\n\x0b\x0c\r\x1c\x85\u2003") for _ in range(rng.randint(0, 30))) for _ in range(500))]:
        assert j.plain(text) == b" ".join((text or "").lower().encode().split())


def test_signing_costs_a_few_times_what_splitting_costs():
    import time

    import pyarrow as pa

    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])

    def least(f):
        took = []
        for _ in range(3):
            began = time.thread_time()
            f()
            took.append(time.thread_time() - began)
        return min(took)

    # 34 times as long as splitting with a dictionary of word hashes and min-hashes of 64 bits, 3 times without (measured once)
    assert least(lambda: list(jaccard_join._signed(iter([batch])))) < 6 * least(lambda: [t.lower().encode().split() for t in texts])


def test_min_hashes_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    for similarity in (0.6, 0.8, 0.9):
        same = []
        for _ in range(100):
            h = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
            both, rest = int(300 * similarity), int(300 * (1 - similarity) / 2)
            s = jaccard_join.signatures(np.concatenate([h[: both + rest], h[:both], h[both + rest :]]), np.array([0, both + rest, 300 + both]))
            same.append((s[0] == s[1]).reshape(jaccard_join.TREES, jaccard_join.DEPTH))
        assert abs(np.mean(same) - similarity) < 0.02
        assert abs(np.mean(np.all(np.array(same)[:, :, :6], axis=2)) - similarity**6) < 0.04


def test_prefixes_shorten_until_the_recall():
    j = jaccard_join
    assert j.least_depth() == 6 and [j.enough_matches(k) for k in (6, 7, 8)] == [0, 2, 7]
    for k in (6, 7, 8):
        assert j.missed(0.8, k) * j.missed(0.6, k) ** j.enough_matches(k) <= 1 - j.TARGET_RECALL
    assert j.missed(0.8, 7) > 1 - j.TARGET_RECALL


def test_ties_follow_the_settled_lengths():
    import pyarrow as pa

    label = lambda *h: np.array(h, dtype=">u2").tobytes()
    same = [1, 1, 1, 1, 1, 1]
    # two texts with eight hashes in common, two others with six in common with them; then a run of seven
    labels = [label(0, *[0] * 7), label(*same, 1, 1), label(*same, 2, 2), label(*same, 2, 2), label(*same, 3, 3), label(2, *[1] * 6, 0), label(2, *[1] * 6, 5), label(9, *[0] * 7)]

    def tied(depths):
        batch = pa.RecordBatch.from_arrays([pa.array([0] * 8, pa.int32()), pa.array(labels, pa.binary()), pa.array(range(8), pa.int64()), pa.array(depths, pa.int32())], ["tree", "label", "rep", "depth"])
        return [(r["a"], r["b"]) for b in jaccard_join._ties(6)(iter([batch])) for r in b.to_pylist() if r["tree"] is None]

    assert tied([8] * 8) == [(2, 3)]
    assert tied([8, 6, 8, 8, 8, 8, 8, 8]) == [(1, 2), (2, 3), (3, 4)]
    assert tied([8, 8, 8, 8, 7, 8, 7, 8]) == [(2, 3), (5, 6)]

    batch = pa.RecordBatch.from_arrays([pa.array([0] * 8, pa.int32()), pa.array(labels, pa.binary()), pa.array(range(8), pa.int64())], ["tree", "label", "rep"])
    for size in (1, 3, 8):
        got = [(r["rep"], r["match"]) for b in jaccard_join._matched(6)(batch.slice(a, size) for a in range(0, 8, size)) for r in b.to_pylist()]
        assert got == [(0, 0), (1, 6), (2, 8), (3, 8), (4, 6), (5, 7), (6, 7), (7, 0)]


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    edges = {(min(a, b), max(a, b)) for a, b in [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] if a != b}
    chain = list(range(1000, 1200))
    rng.shuffle(chain)
    edges |= {(min(a, b), max(a, b)) for a, b in zip(chain, chain[1:])} | {(2000, k) for k in range(2001, 2300)}
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert set(got) == set(root) and len(set(got.values())) == len(set(root.values())) == len({(got[n], root[n]) for n in root})


@pytest.mark.parametrize("few", [0, 40, 1 << 20])
def test_components_in_rounds_and_in_one_task(few, spark, monkeypatch):
    written, materialize = [], jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    monkeypatch.setattr(jaccard_join, "FEW_EDGES", few)
    chain = list(range(300))
    random.Random(8).shuffle(chain)
    edges = [(min(a, b), max(a, b)) for a, b in zip(chain[:200], chain[1:200])] + [(1000, 1001), (1000, 1002), (1 << 60, 5 + (1 << 60))]
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {n for e in edges for n in e}
    for group in (chain[:200], range(1000, 1003), [1 << 60, 5 + (1 << 60)]):
        assert len({got[n] for n in group}) == 1 and got[group[0]] in group
    # few edges cost two small tables, instead of five for each round
    assert (len(written) == 2) == (few > len(edges))
    assert jaccard_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_connected_against_sets():
    rng = np.random.default_rng(7)
    for n, m in [(1, 0), (2, 1), (50, 20), (50, 45), (400, 390), (400, 2000)]:
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        group = {k: {k} for k in range(n)}
        for x, y in zip(a.tolist(), b.tolist()):
            for k in (both := group[x] | group[y]):
                group[k] = both
        assert jaccard_join.connected(n, a, b).tolist() == [min(group[k]) for k in range(n)]


@pytest.mark.parametrize("batches, words", [(1, 10000), (30, 100)])
def test_signing_holds_a_bounded_part_of_the_texts(batches, words):
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(9)
    texts = [[" ".join(f"w{rng.randrange(10**9)}" for _ in range(words)) for _ in range(64)] for _ in range(batches)]
    given = [pa.RecordBatch.from_arrays([pa.array(range(64)), pa.array(t)], ["doc_id", "text"]) for t in texts]
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in jaccard_join._signed(iter(given))) == 64 * batches
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 64 long texts are not hashed together, and words are not kept from one batch to the next
    assert peak < 20_000_000


def test_masks_hit_every_stretch():
    from itertools import combinations

    w = decontamination.WINDOW
    for wrong in combinations(range(w), decontamination.SUBSTITUTIONS):
        assert any(all(p + o not in wrong for o in m) for m in decontamination.MASKS for p in range(w - decontamination.SPAN + 1))


def test_decontamination_tolerates_substitutions(spark, odd):
    item = " ".join(f"w{i}" for i in range(20))
    two = item.replace("w3 ", "x ").replace("w9 ", "y ")
    three = " ".join(f"w{i}" if i % 4 else "z" for i in range(20))
    docs = spark.createDataFrame([(1, f"a b c {item} d"), (2, f"q {two.upper()}!"), (3, three), (4, None), (5, ""), (6, " ".join(f"w{i}" for i in range(10))), (1, f"a b c {item} d")], "doc_id long, text string").withColumn("item_id", F.lit(7)).withColumn("seed", F.lit(7))
    items = spark.createDataFrame([(10, item), (11, None), (12, "w0 w1 w2"), (13, "w1 w2 w3 w4 w5 w6 w7 w8"), (10, item)], "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontamination.contaminated(docs, items).collect()}
    # every 13 tokens of the second text hold its substitution at 9
    assert got == {(1, 10): 13, (2, 10): 12, (1, 13): 8, (6, 13): 8}
    assert decontamination.contaminated(docs.limit(0), items).count() == 0 and decontamination.contaminated(odd, items.limit(0)).count() == 0
    assert decontamination.decontaminate(docs, items).count() == 3


def test_decontamination_in_several_passes(spark, odd, sf_dir, monkeypatch):
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    want = sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 300)
    monkeypatch.setattr(decontamination, "MOST_PASSES", 1000)
    assert want and sorted(map(tuple, decontamination.contaminated(docs, items).collect())) == want
    monkeypatch.setattr(decontamination, "MOST_PASSES", 1)
    assert sorted(map(tuple, decontamination.contaminated(docs, items).collect())) == want
    clash = odd.withColumn("_bad", F.lit(1)).withColumn("bad", F.lit(1)).withColumn("item_id", F.lit(1)).withColumn("seed", F.lit(1))
    assert decontamination.decontaminate(clash, items).columns == clash.columns and decontamination.decontaminate(clash, items).count() == odd.count()


def test_pipeline_stages_bear_odd_rows(spark, odd, sf_dir):
    import corpus_pipeline

    odd = odd.withColumn("_gone", F.lit(1)).withColumn("bad", F.lit(1)).withColumn("n", F.lit(1)).withColumn("score", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf_dir)
        assert name == "packing" or got.columns == odd.columns
        # only the stage on copies drops one of them; junk may go for its quality
        assert got.where("doc_id = 4").count() == (1 if name == "near_copies" else 0 if name == "quality" and got.where("doc_id = 4").count() == 0 else 2)
        assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_html_query_by_brute_force(spark, fixture_dir):
    import html

    got = {r.page_id: r for r in QUERIES["op9_html"](spark, fixture_dir).collect()}
    for r in read_table(spark, fixture_dir, "pages").collect():
        m = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        body = m[1] if m else ""
        if not (m and m[2]):
            body = re.sub(r"<[^>]*\Z", "", body.split("<footer")[0])
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", body)]
        want = "\n\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_html_blocks():
    page = '<html><body><div class="cookie-notice">We use cookies</div><main><h1>A &amp; B</h1>Loose <i>text</i><br>here<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></main><section id="comments"><p>hey</p></section><p>tail &am'
    assert [t for _, t in html_extract.blocks(page)] == ["A & B", "Loose text here", "one", "two", "c1", "c2", "tail &am"]
    texts = lambda page: [t for _, t in html_extract.blocks(page)]
    assert texts("<p title=it's>One</p><p>don't stop</p><p>Three</p>") == ["One", "don't stop", "Three"]
    assert texts("<p title='a > b' data-x=\"c > d\">One</p><p a = 'x>y'>Two</p><br/>Three") == ["One", "Two", "Three"]
    assert texts("<p>x</p>" * 20000 + "<a href='" * 200)[:20000] == ["x"] * 20000
    assert html_extract.blocks("") == [] and html_extract.blocks("<p") == [] and html_extract.blocks("plain") == [("", "plain")]


def test_html_removes_what_a_site_repeats(spark):
    rows = [(i, f"http://h.example/{i}", f"<div><span>Same on every page</span></div><div class=x><p>Text {i} of its own</p></div>") for i in range(40)]
    rows += [(100, None, None), (101, "odd", ""), (102, "http://h.example/1", rows[1][2])]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("path", F.lit(1))
    got = {r.page_id: r.text for r in html_extract.extract(d).collect()}
    assert got[3] == "Text 3 of its own" and got[102] == got[1] == "Text 1 of its own" and got[100] == got[101] == ""
    assert html_extract.extract(d.limit(0)).count() == 0


def test_html_roles_do_not_remove_article_text(spark):
    own = "<article><header><h1>Title {0}</h1></header><section id=discussion><p>Debate {0}</p></section><p class=share-price>Price {0}</p><figure><figcaption>Caption {0}</figcaption></figure><math><mi>x{0}</mi></math><div class=share>Share this</div></article>"
    rows = [(i, f"http://h.example/{i}", f"<nav>Menu</nav>{own.format(i)}<footer>Foot {i}</footer>") for i in range(60)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Title 7\n\nDebate 7\n\nPrice 7\n\nCaption 7\n\nx7"


@pytest.mark.parametrize("pages", [19, 20, 40])
def test_html_keeps_articles_that_recur(pages, spark):
    # few articles in many copies, each page with a script of its own; headings that recur
    page = "<div><span>Same on every page</span></div><script>var id={0}</script><article><h2>Method</h2><p>Article {1}</p></article>"
    plain = "<script>var id={0}</script><div class=x><p>Article {1}</p></div>"
    rows = [(i, f"http://a.example/{i}", page.format(i, i % 4)) for i in range(pages)] + [(100 + i, f"http://b.example/{i}", plain.format(i, i % 4)) for i in range(pages)]
    rows += [(200 + i, "http://c.example/", f"<article><h2>Method</h2><p>Other {i}</p></article>") for i in range(pages)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].endswith(f"Method\n\nArticle {i % 4}") and got[100 + i] == f"Article {i % 4}" and got[200 + i] == f"Method\n\nOther {i}" for i in range(pages))


def test_quality_rules_bear_odd_rows(odd):
    got = quality_rules.judge(odd)
    assert got.count() == odd.count() and quality_rules.judge(odd.limit(0)).count() == 0
    assert {r.doc_id: r.n_words for r in got.collect()} == {1: 0, 2: 0, 3: 0, 4: 3, None: 7, 5: 30000, 6: 3}


def test_buckets_hold_their_numbers(spark):
    d = spark.createDataFrame([(v,) for v in [*range(2000), 10**6, 10**12]], "v long")
    d = d.withColumn("b", quality_rules.bucket_of(F.col("v"))).withColumn("top", quality_rules.bucket_top(F.col("b")))
    for r in d.collect():
        assert r.v <= r.top <= r.v * 129 / 128 + 1
    bs = [r.b for r in d.orderBy("v").collect()]
    assert bs == sorted(bs)


def test_limits_follow_their_groups(spark):
    """Sources of other lengths and habits get other limits, whatever their number of rows; equal rows fare alike."""
    text = lambda words, marks, k: " ".join([f"w{k}x{i}" for i in range(words)] + ["###"] * marks)
    rows = [(k, text(60 + k % 30, 0, k), "en", "prose") for k in range(300)] + [(1000 + k, text(60 + k % 30, 2 + k % 9, k), "en", "code") for k in range(300)]
    rows += [(2000 + k, text(60, 40 * (k % 2), k), "en", "prose" if k < 2 else "code") for k in range(4)] + [(3000 + k, text(30, 0, k), "de", "few") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert got[1000].max_symbols > 2 * got[0].max_symbols and got[1000].max_dup_lines == pytest.approx(got[0].max_dup_lines, rel=0.1)
    assert all(r.kept for i, r in got.items() if i < 2000) and not got[2001].kept and got[2000].kept and got[3000].kept
    # three rows of a language hardly move the table's limit
    assert got[3000].max_symbols == pytest.approx(max(got[0].max_symbols, got[1000].max_symbols), rel=0.8)


def test_quality_rules_keep_clean_documents(spark, fixture_dir):
    docs = read_table(spark, fixture_dir, "documents")
    got = quality_rules.judge(docs).join(read_table(spark, fixture_dir, "labels"), "doc_id").where("not base_failed").toPandas()
    assert got[got["quality"] == 1]["kept"].mean() > 0.99 and got[got["quality"] == 0]["kept"].mean() < 0.1
    assert got.groupby(["lang", "source"])["max_symbols"].first().nunique() > 20


def test_pipeline_by_brute_force(spark, sf_dir):
    """Each stage's decision, recomputed plainly from the models and the brute-force joins."""
    import corpus_pipeline

    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    by_name = dict(corpus_pipeline.STAGES)
    mild = materialize(by_name["toxicity"](spark, docs, sf_dir), "t")
    assert mild.columns == docs.columns
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.score >= toxicity.THRESHOLD}
    assert {r.doc_id for r in mild.collect()} == {r.doc_id for r in docs.collect()} - bad
    good = materialize(by_name["quality"](spark, mild, sf_dir), "t")
    low = {r.doc_id for r in quality_model.score(mild, quality_model.fit(mild, labels)).collect() if r.score < quality_model.THRESHOLD}
    rows = [(r.doc_id, r.text) for r in mild.collect() if r.doc_id not in low]
    assert {r.doc_id for r in good.collect()} == {i for i, _ in rows}
    single = materialize(by_name["near_copies"](spark, good, sf_dir), "t")
    links = brute_links(rows)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i in links if links[i][0] == i)
    clean = materialize(by_name["benchmark"](spark, single, sf_dir), "t")
    leaks = {r.doc_id for r in decontamination.contaminated(single, read_table(spark, sf_dir, "benchmark")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaks and clean.columns == docs.columns
    packed = by_name["packing"](spark, clean, sf_dir).toPandas()
    assert set(packed["doc_id"]) == {r.doc_id for r in clean.collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)
