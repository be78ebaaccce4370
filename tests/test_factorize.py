from hypothesis import given, settings
from hypothesis import strategies as st

from textindex_spark.operators import coding, factorize, factors, textindex

TEXTS = st.lists(st.sampled_from([0, 97, 98, 99, 255]), max_size=80).map(bytes)


def decoded(f):
    return factors.expand([s for s, _ in f], [n for _, n in f], [s for s, _ in f])


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_factorizers_round_trip(t):
    for f in factorize.ALGORITHMS.values():
        assert decoded(f(t)) == t
    for kw in ({"window": 4}, {"window": 4, "extend": True}, {"window": 4, "long_term_q": 3}):
        assert decoded(factorize.sliding_window(t, **kw)) == t
    assert decoded(factorize.fingerprints(t, 0, 2)) == t
    assert decoded(factorize.top_fingerprints(t, 1, 2, 1, 2)) == t
    assert decoded(factorize.sketched(t, 3, 2)) == t
    assert decoded(factorize.qgram_table(t, 2, 2)) == t
    assert factorize.lz78_decode(factorize.lz78_phrases(t)) == t


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_lz77_is_greedy_and_longest(t):
    i = 0
    for _, n in factorize.lz77(t):
        best = max((next((k for k in range(len(t) - i, 0, -1) if all(t[j + x] == t[i + x] for x in range(k))), 0) for j in range(i)), default=0)
        assert max(n, 1) == (best if best >= 2 else 1)
        i += max(n, 1)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_merge_takes_the_longest_and_decodes(t):
    a, b, c = factorize.lz77(t), factorize.sliding_window(t, 8), factorize.gzip_style(t)
    assert decoded(factors.merge_lists(a, b)) == t
    assert decoded(factors.merge_lists(a, b, c)) == t


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_suffix_array(t):
    order, lcp = textindex.suffix_array(t)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    for r in range(1, len(t)):
        a, b = t[order[r - 1] :], t[order[r] :]
        assert lcp[r] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_known_parses():
    assert factorize.lz78_phrases(b"aaaa") == [(0, 97), (1, 97), (1, None)]
    assert factorize.gzip_style(b"abcdef") == [(c, 0) for c in b"abcdef"]
    assert factorize.gzip_style(b"abcabcabcabc") == [(97, 0), (98, 0), (99, 0), (0, 9)]
    assert factorize.lz77(b"") == [] and factorize.lz77(b"a") == [(97, 0)]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_codes_round_trip(t):
    weights, bits = coding.huffman_encode(t)
    assert coding.huffman_decode(weights, bits) == t
    assert len(bits) == sum(n * k for n, k in zip(weights.values(), coding.code_lengths(list(weights.values()))))
    tree = coding.Adaptive()
    bits, other, at, out = "".join(map(tree.encode, t)), coding.Adaptive(), 0, []
    for _ in t:
        symbol, at = other.decode(bits, at)
        out.append(symbol)
    assert bytes(out) == t and at == len(bits)
    assert all(a >= b for a, b in zip(tree.weight, tree.weight[1:]))


def test_forward_code_ends_free():
    assert coding.forward_bits(b"aaaa") == 0
    assert coding.forward_bits(b"ab") == 1  # once a is used up, b costs nothing


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_containers_round_trip(t):
    f = factorize.lz77(t)
    bits = coding.write_factors(f)
    assert coding.read_factors(coding.from_bytes(coding.to_bytes(bits), len(bits))) == f


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_coders_round_trip(t):
    for name, (encode, decode) in coding.CODERS.items():
        bits = encode(t)
        assert decode(coding.from_bytes(coding.to_bytes(bits), len(bits))) == t, name
    assert coding.adaptive_bits(t) == len(coding.adaptive_encode(t))
    counts = {c: t.count(c) for c in set(t)}
    ahead, number = (len(coding.write_histogram(counts)), len(coding.write_delta(len(counts)))) if t else (0, 0)
    assert coding.forward_bits(t) == len(coding.forward_encode(t)) - ahead
    assert coding.forward_bits(t, True) == len(coding.hybrid_encode(t)) - number


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_falling_tree_stays_a_huffman_tree(t):
    """At each step the weighted path length is that of a Huffman code of what is still to come."""
    left = {s: t.count(s) for s in set(t)}
    tree = coding.Falling(left)
    for c in t:
        best = sum(n * k for n, k in zip(left.values(), coding.code_lengths(list(left.values()))))
        assert tree.counts() == left and sum(n * tree.depth(s) for s, n in left.items()) == best
        tree.use(c)
        left[c] -= 1
        left = {s: n for s, n in left.items() if n}
    assert not tree.leaf


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_previous_matches(t):
    rank, before, after, *lengths = textindex.previous_matches(t)
    lpf = [max(k) for k in zip(*lengths)]
    order = sorted(range(len(t)), key=lambda i: t[i:])
    for i in range(len(t)):
        low = [j for j in order[: rank[i]] if j < i]
        high = [j for j in order[rank[i] + 1 :] if j < i]
        assert order[rank[i]] == i and before[i] == (low[-1] if low else -1) and after[i] == (high[0] if high else -1)
        assert lpf[i] == max((next((k for k in range(len(t) - i, 0, -1) if all(t[j + x] == t[i + x] for x in range(k))), 0) for j in range(i)), default=0)
