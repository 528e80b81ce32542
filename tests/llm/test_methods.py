"""The methods by themselves: round trips, exactness against brute force, held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import langid, ngram_lm, quality, secret_scan, simhash, token_ids, toxicity


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple_8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    words, offsets = token_ids.encode(x)
    assert (token_ids.decode(words, offsets, len(x)) == x).all()
    assert len(offsets) == -(-len(x) // token_ids.RUN)


def test_simple_8b_is_small():
    words, _ = token_ids.encode(np.zeros(120 * 8, np.uint64))
    assert len(words) <= 9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=300), st.lists(st.integers(0, 2**40), min_size=1, max_size=20))
def test_elias_fano(values, asked):
    v, q = np.sort(np.array(values)), np.array(asked)
    e = ngram_lm.EliasFano.build(v)
    assert (e.access(np.arange(len(v))) == v).all()
    assert (e.successor(np.zeros(len(q), int), np.full(len(q), len(v)), q) == np.searchsorted(v, q)).all()


def test_a_shard_sums_to_one_and_maps(tmp_path):
    rng = random.Random(1)
    words = [3, 7, 8, 20, 21, 50]
    text = [rng.choice(words) if rng.random() < 0.8 else 3 for _ in range(3000)]
    counts = Counter(text[:-1])
    two, three = Counter(zip(text, text[1:], strict=False)), Counter(zip(text[1:], text, text[2:], strict=False))  # (v, u, w)
    pairs = Counter()
    for (v, u, _), n in three.items():
        pairs[v, u] += n
    rows = lambda c: np.array([(*k, n) for k, n in sorted(c.items()) if n >= ngram_lm.LEAST])
    names = np.array(sorted(counts))
    trie = ngram_lm.Trie.build(rows(two), rows(three), names, np.array([counts[x] for x in names]), np.array(sorted(pairs)), np.array([pairs[k] for k in sorted(pairs)]))
    (tmp_path / "trie").write_bytes(trie.to_bytes())
    again = ngram_lm.Trie.map(str(tmp_path / "trie"))
    w = np.array([*words, 99])
    for v in (3, 20, 99):
        for u in (7, 50, 99, -1):
            f2, g2, f3, g3 = map(ngram_lm.restore, again.parts(np.full(len(w), v), w, np.full(len(w), u)))
            assert f2.sum() + g2[0] == pytest.approx(1, abs=0.005) and f3.sum() + g3[0] == pytest.approx(1, abs=0.005)
            for x, a, b in zip(w, f2, f3, strict=True):
                n2, n3 = two.get((v, x), 0), three.get((v, u, x), 0)
                assert a == pytest.approx((n2 - 0.75) / counts[v] if n2 >= 2 else 0, rel=0.005)
                assert b == pytest.approx((n3 - 0.75) / pairs[v, u] if n3 >= 2 else 0, rel=0.005)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2**33), st.integers(0, 9), st.integers(-2, 9), st.integers(0, 5)), min_size=1, max_size=80, unique_by=lambda x: x[:3]))
def test_packed_grams_round_trip(rows):
    v, w, u, n = (np.array(x) for x in zip(*sorted(rows), strict=True))
    names, of = np.unique(v, return_inverse=True)
    got = ngram_lm.unpack_grams(ngram_lm.pack_grams(v, w, u, n, names % 1000))
    assert all((a == b).all() for a, b in zip(got, (v, w, u, n, (names % 1000)[of]), strict=True))


def sent_grams(rng, blocks, words, size, shift=0, top=4):
    """What blocks send a shard: random distinct grams of each, packed and as a dictionary of counts. Words from 4 times ``words`` / 5 on are hot."""
    packed, told = [], []
    for _ in range(blocks):
        rows = np.unique(np.stack((rng.integers(1, words, size), rng.integers(0, words, size), rng.integers(-2, words, size)), 1), axis=0)
        v, w, u = (rows + np.where(rows > 0, shift, 0)).T
        n, names = rng.integers(0, top, len(v)), np.unique(v)
        packed.append(ngram_lm.pack_grams(v, w, u, n, np.where(names - shift >= words * 4 // 5, 1000 + names - shift, 0)))
        told.append(list(zip(*map(np.ndarray.tolist, (v, w, u, n)), strict=True)))
    return packed, told


@pytest.mark.parametrize(("gather", "shift"), [(10**9, 0), (1, 0), (700, 0), (700, 2**40)])
def test_a_shard_sums_the_grams_of_all_blocks_however_many_it_takes_at_once(monkeypatch, gather, shift):
    monkeypatch.setattr(ngram_lm, "GATHER", gather)
    packed, told = sent_grams(np.random.default_rng(4), 9, 12, 300, shift)
    values, found, count, of, names, counts = ngram_lm.gather_grams(packed[:])
    grams = [(v, w, u - 2) for v, w, u in zip(*(value[x].tolist() for value, x in zip(values, found, strict=True)), strict=True)]
    want = Counter()
    for rows in told:
        for v, w, u, n in rows:
            want[v, w, u] += n
    assert grams == sorted(want) and dict(zip(grams, count.tolist(), strict=True)) == want
    assert [[grams[k] for k in part.tolist()] for part in of] == [[x[:3] for x in rows] for rows in told]
    assert dict(zip(names.tolist(), counts.tolist(), strict=True)) == {v + shift: 1000 + v for v in range(9, 12)}


def at_a_shard(packed):
    rows = list(enumerate(packed))
    table = pa.table({"shard": pa.array([0] * len(rows), pa.int32()), "block": pa.array([k for k, _ in rows], pa.int64()), "data": pa.array([x for _, x in rows], pa.binary()), "more": pa.nulls(len(rows), pa.binary())})
    return [r for b in ngram_lm._count_grams(iter(table.to_batches())) for r in b.to_pylist()]


def test_a_shard_answers_alike_however_many_rows_it_takes_at_once(monkeypatch):
    packed, _ = sent_grams(np.random.default_rng(5), 9, 12, 300)
    want = at_a_shard(packed)
    for name, value in (("GATHER", 400), ("LOOK", 7), ("MARKS", 2)):
        monkeypatch.setattr(ngram_lm, name, value)
    assert at_a_shard(packed) == want and len(want) == 10


@pytest.mark.parametrize(("words", "gather", "most"), [(3000, 10**9, 110), (40, 60_000, 40)])
def test_a_shard_holds_few_bytes_a_row(monkeypatch, words, gather, most):
    """Of grams that are new in each block, and of grams that the blocks repeat."""
    import tracemalloc

    monkeypatch.setattr(ngram_lm, "GATHER", gather, raising=False)
    packed, told = sent_grams(np.random.default_rng(6), 30, words, 20_000, top=2)
    rows = sum(map(len, told))
    del told
    tracemalloc.start()
    try:
        at_a_shard(packed)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < most * rows, peak / rows


def test_rows_of_ranks_are_told_apart_however_wide():
    rng = np.random.default_rng(2)
    narrow = [rng.integers(0, 9, 400) for _ in range(3)]
    for columns in (narrow, [x << 28 for x in narrow]):
        *found, of = ngram_lm.distinct(*columns)
        want, inverse = np.unique(np.stack(columns, 1), axis=0, return_inverse=True)
        assert (np.stack(found, 1) == want).all() and (of == inverse.ravel()).all()


def test_golay_anchors_cover():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 21, 400)
    home, row, anchor = simhash.anchors(x)
    assert (np.bitwise_count((home ^ x).astype(np.uint64)) <= 3).all()
    y = x ^ (1 << rng.integers(0, 21, 400))
    reach = {(int(r), int(a)) for r, a in zip(*simhash.anchors(y)[1:], strict=True)}
    assert all((i, int(h)) in reach for i, h in enumerate(home))


@pytest.mark.parametrize("near,chunk", [(4, 4096), (4, 2), (11, 4096), (11, 3)])
def test_links_find_all_components(spark, monkeypatch, near, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)  # with few rows in a chunk all anchors are hot
    rng = np.random.default_rng(near)
    seeds = rng.integers(0, 2**63, 40)
    prints = list(seeds)
    for s in seeds:
        for _ in range(4):
            flips = rng.choice(63, rng.integers(1, near + 3), replace=False)
            prints.append(int(s) ^ int(sum(1 << int(b) for b in flips)))
    prints = sorted({int(p) for p in prints})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    group = {p: p for p in prints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= near and root(a) != root(b):
                group[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, near)).collect()}
    assert {p: got.get(p, p) for p in prints} == {p: root(p) for p in prints}


def test_grammar():
    words, stems = toxicity.lexicon({"zork": "I", "blar*": "J"})
    classes, machine = toxicity.Classes(words, stems), toxicity.Grammar()

    def found(text):
        counts, _ = toxicity.matches(text, classes, machine)
        return {m: c for m, c in zip(toxicity.MATCHES, counts, strict=True) if c}

    assert found("You zork!") == {"A": 1} and found("a zork, you see") == {"A": 1} and found("a zork. You see") == {"I": 1}
    assert found("this is no zork") == {"i": 1} and found("she said zork") == {"p": 1} and found("the clerk said: zork") == {"I": 1}
    assert found("not a zork or blarney") == {"i": 1, "j": 1} and found("not tall, a zork") == {"I": 1} and found("not a zork but blarney") == {"i": 1, "J": 1}
    assert found("blarney here") == {"J": 1} and found("nothing here") == {}
    assert found("I will kill you") == {"D": 1} and found("they kill time") == {"T": 1} and found("never hurt you") == {"t": 1} and found("he wrote I kill you") == {"q": 1}


def _by_rules(clause):
    """The grammar as conditions on what stands where, written without transducers."""
    out, negated_at, reach = [], None, 0
    for i, c in enumerate(clause):
        after, before = "Y" in clause[i + 1 :], "Y" in clause[:i]
        if c == "N":
            reach, negated_at = toxicity.NEGATION_SCOPE, None
        elif c == ",":
            reach, negated_at = 0, None
        elif c == "C" and negated_at == i - 1:
            reach = toxicity.NEGATION_SCOPE
        elif c in "IJKT":
            if reach > 0:
                reach, negated_at = 0, i
                kind = c.lower()
            elif c == "T":
                kind = "D" if after else "T"
            else:
                kind = dict(zip("IJK", "ABC", strict=True))[c] if after or before else c
            if "R" in clause[:i]:
                kind = "q" if c == "T" else "p"
            out.append(kind)
        else:
            reach = max(0, reach - 1)
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(toxicity.ALPHABET, max_size=12))
def test_grammar_by_brute_force(clause):
    assert [c for c in toxicity.Grammar().run(clause) if c in toxicity.MATCHES] == _by_rules(clause)


def test_decision_list():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 2))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5)
    rules = quality.learn(x, bad, np.arange(3000) % 3, ["symbol_ratio", "upper_ratio"])
    held = rng.random((2000, 2))
    said = np.zeros(2000, bool)
    for r in rules:
        said |= r.holds(held, ["symbol_ratio", "upper_ratio"])
    assert (said == ((held[:, 0] > 0.8) & (held[:, 1] < 0.5))).mean() > 0.97
    assert quality.learn(x, np.zeros(3000, bool), np.arange(3000) % 3, ["symbol_ratio", "upper_ratio"]) == []


def test_language_model_is_sparse_and_right():
    rng = random.Random(2)
    kinds = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ber"], "cc": ["eau", "tion", "oi"]}
    make = lambda l: " ".join("".join(rng.choice(kinds[l]) for _ in range(3)) for _ in range(12))  # noqa: E731, E741
    train = [(make(l), l) for l in sorted(kinds) * 40]  # noqa: E741
    idf = np.ones(langid.BUCKETS)
    w = langid.ftrl([langid.vector(langid.grams(t), idf) for t, _ in train], np.array([sorted(kinds).index(l) for _, l in train]), 3)  # noqa: E741
    model = langid.Model(sorted(kinds), idf, w, 1.0)
    assert all(model.predict(make(l))[0] == l for l in sorted(kinds) * 10)  # noqa: E741
    assert (w == 0).mean() > 0.9 and model.predict("12 !")[0] == "und"


def test_field_finds_secrets_that_no_pattern_has():
    field = secret_scan.Field()
    made = secret_scan.made_lines(400, seed=1)
    field.train([e for t, s in made if (e := secret_scan.example(t, s, field, secret_scan.file_features(t)))])
    scanner = secret_scan.Scanner(field)
    right = wrong = missed = 0
    for text, secrets in secret_scan.made_lines(200, seed=9):
        found = scanner.decode(text, [])
        hit = [any(a < y and b > x for a, _, b in found) for x, y in secrets]
        right, missed = right + sum(hit), missed + len(hit) - sum(hit)
        wrong += sum(not any(a < y and b > x for x, y in secrets) for a, _, b in found)
    assert right > 9 * missed and wrong < 0.15 * right


def test_viterbi_is_exact():
    rng = np.random.default_rng(3)
    field = secret_scan.Field()
    field.trans += rng.normal(size=(3, 3))
    from itertools import product

    for n in (1, 3, 6):
        e = rng.normal(size=(n, 3))
        score = lambda t: e[range(n), t].sum() + sum(field.trans[a, b] for a, b in zip(t, t[1:], strict=False)) - 20.0 * (t[0] == 1)  # noqa: B023, E731
        assert tuple(field.viterbi(e)) == max(product(range(3), repeat=n), key=lambda t: score(list(t)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aB9:=_- \n\t,\"'/.xé中\u3000\xa0\x1c[]")), max_size=60), min_size=1, max_size=4), st.integers(0, 5))
def test_all_tokens_are_decoded_as_one_by_one(texts, seed):
    rng = np.random.default_rng(seed)
    field = secret_scan.Field()
    field.emit = rng.normal(size=field.emit.shape)
    field.trans = field.trans + rng.normal(size=(3, 3))
    for text, (starts, ends, tags) in zip(texts, secret_scan.Scanner(field).tags(texts), strict=True):
        spans = secret_scan.tokens_of(text)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == spans
        if spans:
            e = field.emissions(field.features([text[a:b] for a, b in spans], secret_scan.file_features(text)))
            assert tags.tolist() == field.viterbi(e)


def test_long_texts_are_decoded_whole():
    rng = np.random.default_rng(7)
    trans, e = rng.normal(size=(3, 3)), rng.normal(size=(5000, 3)) * 2
    field = secret_scan.Field()
    field.trans = trans
    edge = e.copy()
    edge[0] += secret_scan.START - trans[2]
    assert secret_scan.viterbi_in_step(edge, trans).tolist() == field.viterbi(e)


def test_windows_mark_every_secret_in_them():
    text = "a password: hunter2hunter2 and token=abcdefgh1234 x " + "plain words " * 40 + "v1.2.3-rc and so on " + "other words " * 40
    found = secret_scan.sample_windows(text)
    assert max(len(w["starts"]) for w in found) == 2 and any(not w["starts"] for w in found)
    assert all({w["text"][a:b] for a, b in zip(w["starts"], w["ends"], strict=True)} <= {"hunter2hunter2", "abcdefgh1234"} for w in found)


def _differs(encoder, texts):
    import pyarrow as pa

    ids, sizes = encoder.batch(pa.array(texts))
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    return [t for t, part in zip(texts, parts, strict=True) if part.tolist() != encoder.whole(t).tolist()]


def test_ids_of_chunks_are_those_of_whole_texts():
    rng, encoder = random.Random(4), token_ids.Encoder()
    letters = list("abcXYZ09'`.,!?;:|#$%&*-_()[]{}<>/\\\"~^@+=éÉßñÑΣσς中한ǅİıſÅ²½Ⅷ😀ﬁ١\u095b\u0958") + ["\u0301", "\u0308", "\u0331", "\u0338", "\u094d", "\x1c", "\u200b", "\u3000", "\xa0", "\u2028", " ", " "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    whole = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(rng.choice(whole) if rng.random() < 0.4 else rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    texts += ["<|endoftext|> a", "<|STARTOFTEXT|>", "It's WE'RE", "", "H\u0331 h\u0331. J\u030c", " lead and trail "]
    assert _differs(encoder, texts) == []


def test_cuts_before_signs_hold_for_every_letter_they_are_made_after():
    encoder, signs = token_ids.Encoder(), token_ids.Encoder.SIGNS.decode()
    # All code points, alone and after a letter, before signs; all pairs of a letter below the bound and a sign.
    texts = [f"{b}{chr(c)}{'?' if c % 2 else '.,'}" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 for b in ("", "n")]
    texts += [f"x{chr(c)}{s}{m}" for c in range(1, ord(encoder.LATIN)) for s in signs for m in ("", "\u0301")]
    for k in range(0, len(texts), 20_000):
        assert _differs(encoder, texts[k : k + 20_000]) == []


def test_a_word_is_remembered_once_whatever_signs_it_ends_in():
    rng, encoder = random.Random(6), token_ids.Encoder()
    words = {"".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(2000)}
    texts = [" ".join(w + s for s in ("", ",", ".", "!", "?!")) for w in sorted(words)] + ["X́ it's 5,", "<|endoftext|>", "", "..."]
    assert _differs(encoder, texts) == []
    assert len(encoder.chunks) < len(words) + 20


def test_runs_that_go_ahead_together_are_coded_as_each_alone():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.integers(0, 1 << b, n, np.uint64) for b, n in ((3, 700), (16, 2000), (1, 900), (63, 100), (20, 1500), (5, 7))])
    words, offsets = token_ids.encode(x)
    alone = [token_ids.encode(x[k : k + token_ids.RUN])[0] for k in range(0, len(x), token_ids.RUN)]
    assert words.tolist() == np.concatenate(alone).tolist() and offsets.tolist() == np.cumsum([0, *map(len, alone[:-1])]).tolist()
