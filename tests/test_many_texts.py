"""Hashes, sizes and q-gram counts of many texts at once."""

import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from textindex_spark.functions import hashing
from textindex_spark.operators import batches, coding, textindex, texthash


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=5))
def test_hashes_of_many_texts(texts):
    t = batches.Texts.of(texts)
    fnv, rolling = texthash.powers(hashing.FNV_PRIME, 1 << 32, 400), texthash.powers(hashing.ROLLING_BASE, hashing.MERSENNE61, 400)
    want = []
    for x in texts:
        h, fp = hashing.FNV_BASIS, 0
        for b in x:
            h = (h ^ b) * hashing.FNV_PRIME & hashing.M32
            fp = (fp * hashing.ROLLING_BASE + b) % hashing.MERSENNE61
        want.append((h, fp))
    assert list(zip(texthash.fnv1a(t, fnv).tolist(), texthash.karp_rabin(t, rolling))) == want


def test_hashes_of_rows(spark):
    docs = spark.createDataFrame([(1, "größe"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.crc, r.fnv, r.fingerprint) for r in texthash.hashes(docs).collect()}
    assert set(got) == {1, 2} and got[2] == (0, hashing.FNV_BASIS, 0) and got[1][0] == zlib.crc32("größe".encode())
    docs.createOrReplaceTempView("hashed")
    plan = texthash.hashes(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan


def test_static_sizes_are_those_of_the_codes(spark):
    docs = spark.createDataFrame([(1, "größe\n\x00"), (2, ""), (3, None)], "doc_id long, text string")
    static = ["binary", "delta0", "rice1", "rice8"]
    got = {tuple(r) for r in coding.static_sizes(docs, static).collect()}
    assert got == {(r.doc_id, r.coder, r.n_bits) for r in coding.encode_texts(docs, static).collect() if r.n_bits}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\x00é😀") | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4), st.integers(1, 5))
def test_counted_grams(texts, q):
    want = {}
    for x in texts:
        for i in range(len(x) - q + 1):
            n, low, high = want.get(x[i : i + q], (0, i + 1, i + 1))
            want[x[i : i + q]] = n + 1, min(low, i + 1), max(high, i + 1)
    found = textindex._counted(texts, q)
    assert dict(zip(found[0], zip(*(x.tolist() for x in found[1:])))) == want if found else not want


def test_grams_become_few_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abcd" * 50), (1, "xabcd"), (2, "abc"), (2, None), (None, "abcde")], "g long, text string")
    want = {(1, "abcd"): (51, 1, 197), (1, "bcda"): (49, 2, 194), (1, "cdab"): (49, 3, 195), (1, "dabc"): (49, 4, 196), (1, "xabc"): (1, 1, 1), (None, "abcd"): (1, 1, 1), (None, "bcde"): (1, 2, 2)}
    for most in (1 << 20, 10):
        monkeypatch.setattr(textindex, "COUNTED", most)
        d = textindex.qgrams(docs, 4, ["g"])
        assert {(r.g, r.gram): (r.n, r.first_pos, r.last_pos) for r in d.collect()} == want
    assert "Generate" not in d._jdf.queryExecution().toString()


def test_trees_keep_no_table_of_weights():
    """Leaders are found beside a node; no table of weights is kept, and a tree that grows anew needs no heap."""
    tree = coding.Adaptive()
    bits = "".join(map(tree.encode, b"abracadabra" * 9))
    assert not hasattr(tree, "lead") and coding.adaptive_decode(bits) == b"abracadabra" * 9
    left = coding.Falling({97: 5, 98: 2, 99: 2, 100: 1, coding.ESCAPE: 1})
    assert not hasattr(left, "last") and sum(n * left.depth(s) for s, n in left.counts().items()) == sum(n * k for n, k in zip((5, 2, 2, 1, 1), coding.code_lengths([5, 2, 2, 1, 1])))


def test_broken_static_codes_are_found():
    import pytest

    with pytest.raises(ValueError):
        coding.CODERS["delta0"][1]("0" * 15 + "1")
