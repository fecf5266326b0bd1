"""The training-data operators against brute force, exact round trips and held-out labels, with nulls, ties, empty tables, repeated
rows, very long texts and extra columns."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternq.llm import crf, encoding, hashing, neardup, overlap, packing, pii, quantiles, sampling, spans, texts
from lanternq.llm.pii_examples import KINDS, labelled_texts

WORDS = [f"w{i}" for i in range(400)]


def sentences(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def sets(text: str | None) -> tuple[set, int]:
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}, len(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    notice = sentences(rng, 20)
    rows, base = [], [sentences(rng, rng.randint(35, 80)) for _ in range(40)]
    for i, b in enumerate(base):
        rows.append((i, b + " " + notice, "train"))
        w = b.split()
        for j, cut in enumerate((1, 3, 9)):
            v = list(w)
            for _ in range(cut):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            rows.append((1000 + 10 * i + j, " ".join(v) + (" " + notice if j else ""), ("gold", "test", "train")[j]))
        rows.append((5000 + i, " ".join(w[5:]).upper(), "validation"))
    rows += [(7000, base[0] + " " + notice, "gold"), (7001, None, "train"), (7002, "", "test"), (7003, "a few words", "train"), (None, base[1], "train"), (7004, base[2], None)]
    rows += [(7100 + i, notice + " " + sentences(rng, 15), "train") for i in range(30)]
    rows += rows[:5]
    rows.append((7999, " ".join(base) * 8, "train"))
    return rows


def frame(spark, corpus):
    return spark.createDataFrame([(*r, 1, "z") for r in corpus], "id bigint, body string, split string, rep int, k0 string")


def test_near_duplicates_equal_brute_force(spark, corpus):
    links, members = neardup.near_duplicates(frame(spark, corpus), "id", "body", similarity=0.5, min_words=30)
    got = {tuple(r) for r in texts.expand_links(links, members).collect()}
    docs = {i: sets(t) for i, t, _ in corpus if i is not None and t}
    want = set()
    for a, b in itertools.combinations(sorted(docs), 2):
        (x, n), (y, m) = docs[a], docs[b]
        if n >= 30 and m >= 30 and 2 * len(x & y) >= len(x | y):
            want.add((a, b))
    assert len(want) > 50 and got == want
    groups = {r["k0"]: r["group_id"] for r in neardup.components(links, members).collect()}
    assert set(groups) == {i for i, (_, n) in docs.items() if n >= 30}
    assert all(groups[a] == groups[b] for a, b in want)


def test_allocation_is_cheapest():
    rng = np.random.default_rng(1)
    both, some = rng.integers(1, 50, (30, 4)).astype(float), rng.integers(1, 90, (30, 4)).astype(float)
    t = neardup.allocate(both, some, 5)
    for r in range(30):
        cost = lambda ts: sum((0, both[r, i], some[r, i])[x + 1] for i, x in enumerate(ts))  # noqa: B023, E731
        assert sum(t[r] + 1) >= 5
        assert cost(t[r]) == min(cost(c) for c in itertools.product((-1, 0, 1), repeat=4) if sum(c) + 4 >= 5)


def test_nibbles_never_exceed_the_distance(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 40, (20, 32)).astype(np.uint32)
    n = neardup.nibbles(a)
    rows = [(i, j, *map(int, n[i]), *map(int, n[j])) for i in range(20) for j in range(20)]
    df = spark.createDataFrame(rows, "i int, j int, a0 bigint, a1 bigint, b0 bigint, b1 bigint")
    for r in df.select("i", "j", neardup.differing(["a0", "a1"], ["b0", "b1"]).alias("d")).collect():
        assert r["d"] == int(((a[r["i"]] ^ a[r["j"]]) & 15 != 0).sum()) <= int((a[r["i"]] != a[r["j"]]).sum())


def test_overlaps_equal_brute_force(spark, corpus):
    pairs = overlap.expand(*overlap.contained_pairs(frame(spark, corpus), "id", "body", "split"))
    got = {(r["other_key"], r["train_key"]) for r in pairs.collect()}
    docs = {i: (*sets(t), s) for i, t, s in corpus if i is not None and t and s}
    want = {(a, b) for a, (x, n, s) in docs.items() for b, (y, m, u) in docs.items() if s != "train" and u == "train" and n >= 30 and m >= 30 and 10 * len(x & y) >= 7 * len(x)}
    assert len(want) > 40 and got == want


def test_similar_sequences_have_similar_codes():
    rng = random.Random(2)
    long = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(6, 10))) for _ in range(300)]
    short = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    rows = []
    for _ in range(400):
        w = [rng.choice(long) for _ in range(4)]
        rows += [w[:2] + [rng.choice(short)] + w[2:], w[:2] + [rng.choice(short)] + w[2:], w[:2] + [rng.choice(long)] + w[2:], [rng.choice(long) for _ in range(5)], w[2:] + w[:2] + [rows[-1][0] if rows else "x"]]
    flat, n = hashing.word_arrays([" ".join(w) for w in rows], hashing.WordHasher())
    h, _, at = hashing.sequences(flat, n, 5)
    c = overlap.similarity_codes(flat, at, 5).reshape(400, -1)
    far = lambda i, j: np.bitwise_count(c[:, i] ^ c[:, j])
    assert (c != h.reshape(400, -1)).all()  # no plain hashes
    assert far(0, 1).mean() < 5 < far(0, 2).mean() < 20 < 28 < far(0, 3).mean() < 36
    assert ((far(0, 1) == 1).sum()) > 20  # within the radius of 1, but not equal
    same = [["one", "seven", "eleven", "window", "at"], ["seven", "one", "at", "window", "eleven"]]
    flat, n = hashing.word_arrays([" ".join(w) for w in same], hashing.WordHasher())
    assert len(set(overlap.similarity_codes(flat, hashing.sequences(flat, n, 5)[2], 5).tolist())) == 1


def test_radius_finds_overlaps_without_a_common_sequence(spark):
    """With a low share and a small word changed in every sequence, only codes that differ in a bit bring texts together."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrs") for _ in range(rng.randint(6, 9)))
    found = Counter()
    for radius in (0, 1):
        rng.seed(6)
        rows = []
        for i in range(80):
            w = [word() for _ in range(30)]
            a, b = list(w), list(w)
            for j in range(2, 30, 5):
                a[j], b[j] = rng.choice(["with", "from", "this", "that", "then"]), rng.choice(["onto", "over", "when", "here", "each"])
            rows += [(2 * i, " ".join(a), "train"), (2 * i + 1, " ".join(b), "test")]
        df = spark.createDataFrame(rows, "id bigint, body string, split string")
        links, sides = overlap.contained_pairs(df, "id", "body", "split", share=0.0, radius=radius)
        found[radius] = links.filter("x <> y").count()
    assert found[0] < found[1] and found[1] > 5


def test_pair_counts_equal_expanded_pairs(spark, corpus):
    links, sides = overlap.contained_pairs(frame(spark, corpus), "id", "body", "split")
    want = Counter(r["other_key"] for r in overlap.expand(links, sides).collect())
    assert {r["other_key"]: r["pairs"] for r in overlap.pair_counts(links, sides).collect()} == want and max(want.values()) > 1


def test_parts_of_hot_signatures_meet_once():
    rng = np.random.default_rng(3)
    est, x, y = np.array([9000.0] * 50), rng.integers(0, 10**9, 50), rng.integers(0, 10**9, 60)
    pa, ps = hashing.spread(est, x, True)
    ia, ins = hashing.spread(np.array([9000.0] * 60), y, False)
    meets = Counter((i, j) for i, s in zip(pa, ps) for j, t in zip(ia, ins) if s == t)
    assert set(meets.values()) == {1} and len(meets) == 3000 and set(ps) == set(range(9))


def test_sketches_and_filters(spark):
    df = spark.range(5000).selectExpr("id % 50 as v")
    got = hashing.count_sketch(df, lambda f: f["v"].to_numpy(np.int64), 16)
    want = np.bincount(hashing.bucket_of(np.arange(50), 16), minlength=1 << 16) * 100
    assert (got == want).all() and hashing.count_sketch(df.limit(0), lambda f: f["v"].to_numpy(np.int64), 16).sum() == 0
    assert hashing._add(np.array([2**32 - 2], np.uint32), np.array([9], np.uint32))[0] == 2**32 - 1
    known = spark.range(20).selectExpr("id * 3 as k")
    kept = {r["v"] for r in hashing.keep_known(df.distinct(), "v", known, "k", 20).collect()}
    assert {v for v in range(50) if v % 3 == 0} <= kept and len(kept) < 30
    assert hashing.keep_known(df, "v", known.limit(0), "k", 0).count() == 0


def test_hot_signatures_are_salted(spark, corpus, monkeypatch):
    monkeypatch.setattr(hashing, "salts", lambda e, most=4: np.ceil(e / 4).astype(np.int64))
    links, members = neardup.near_duplicates(frame(spark, corpus), "id", "body", similarity=0.5, min_words=30)
    salted = {tuple(r) for r in texts.expand_links(links, members).collect()}
    monkeypatch.undo()
    links, members = neardup.near_duplicates(frame(spark, corpus), "id", "body", similarity=0.5, min_words=30)
    assert salted == {tuple(r) for r in texts.expand_links(links, members).collect()}


def test_pair_operators_take_empty_tables(spark):
    none = spark.createDataFrame([], "id bigint, body string, split string")
    links, members = neardup.near_duplicates(none, "id", "body")
    assert links.count() == members.count() == texts.expand_links(links, members).count() == neardup.components(links, members).count() == 0
    assert overlap.expand(*overlap.contained_pairs(none, "id", "body", "split")).count() == 0
    links, places, members = spans.shared_spans(none, "id", "body")
    assert links.count() == places.count() == spans.coverage(none, "id", places, members, "body").count() == 0


def brute_spans(rows, n=200):
    seen: dict[str, set] = {}
    for k, t in rows:
        for i in range(len(t or "") - n + 1):
            seen.setdefault(t[i : i + n], set()).add(k)
    return {p for s in seen.values() for p in itertools.combinations(sorted(s), 2)}


@pytest.fixture(scope="module")
def span_rows():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh éß😀.") for _ in range(n))
    shared = [text(rng.randint(190, 420)) for _ in range(12)]
    rows = [(i, text(rng.randint(0, 300)) + shared[i % 12] + text(rng.randint(0, 300))) for i in range(40)]
    notice = text(150)
    rows += [(100 + i, text(120) + notice + text(120)) for i in range(70)]
    hot = text(230)
    rows += [(200 + i, text(30) + hot + text(40)) for i in range(60)]
    rows += [(300, "x" * 450), (301, "ab" + "x" * 260 + "cd"), (302, "-=" * 180), (303, "q" + "-=" * 140), (304, None), (305, ""), (306, rows[0][1]), (307, "\n" * 199)]
    rows.append((308, text(20000) + shared[3] + text(20000)))
    return rows


def test_spans_equal_brute_force(spark, span_rows):
    df = spark.createDataFrame([(*r, "extra") for r in span_rows], "doc_id bigint, text string, rep string")
    for hot in (4, 48, 10**9):  # the result doesn't depend on what counts as hot
        links, places, members = spans.shared_spans(df, hot=hot)
        got = {tuple(r) for r in spans.expand(links, members).collect()}
        assert got == brute_spans(span_rows)
    cover = {r["doc_id"]: r for r in spans.coverage(df, "doc_id", places, members).collect()}
    assert len(cover) == len(span_rows)
    seen = Counter(w for k, t in span_rows for w in {t[i : i + 200] for i in range(len(t or "") - 199)})
    for k, t in span_rows:
        if t is None:
            assert cover[k]["n_chars"] is None and cover[k]["shared_chars"] == 0
            continue
        marked = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                marked[i : i + 200] = True
        assert cover[k]["shared_chars"] == int(marked.sum()), k


def test_spans_in_the_same_texts_are_paired_once(spark):
    rows = [(s, 0, r) for s in range(50) for r in range(40)] + [(99, 0, r) for r in (1, 2, 70)] + [(99, 1, r) for r in (3, 80)] + [(99, 0, 1)]
    df = spark.createDataFrame(rows, "sig bigint, more bigint, rep bigint")
    for most in (4096, 7):
        got = Counter(tuple(r) for r in spans.span_links(df, most).collect())
        assert set(got) == set(itertools.combinations(range(40), 2)) | {(1, 70), (2, 70), (3, 80)}
        assert got[5, 9] == 1 and got[1, 2] == 2


def test_padded_columns_share_spans(spark):
    """Spans of exactly the least length in columns of numbers padded with spaces, where symbols repeat."""
    rng = random.Random(12)
    column = lambda n: "".join(f"{rng.randint(0, 9999):>{rng.choice([6, 8])}}" for _ in range(n // 7 + 2))[:n]
    rows = []
    for i in range(60):
        core = column(200)
        rows += [(2 * i, column(rng.randint(0, 90)) + core + column(rng.randint(0, 90))), (2 * i + 1, "x" * rng.randint(0, 50) + core + column(60))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    links, _, members = spans.shared_spans(df)
    got, want = {tuple(r) for r in spans.expand(links, members).collect()}, brute_spans(rows)
    assert got <= want and len(want - got) <= 1


@given(st.text(alphabet="ab c", min_size=120, max_size=200), st.text(alphabet="ab", max_size=50), st.text(alphabet="ac", max_size=50), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_equal_strings_are_parsed_alike_inside(core, left, right, seed):
    rng = random.Random(seed)
    core = core + "".join(rng.choice("abcdefgh ") for _ in range(120))
    sigs = []
    for t in (left + core + right, right + core + left):
        points, n = spans.characters([t])
        sigs.append(set(spans.chains(*spans.recompress(points, n, 24), 80)[0].tolist()))
    assert sigs[0] & sigs[1]


def test_ids_round_trip_and_equal_whole_texts(spark):
    enc = encoding.load_encoding("byte_bpe_50k", encoding.TOKENIZER_DIR)
    rng = random.Random(3)
    long = " ".join(rng.choice(["it's", "naïve", "<|endoftext|>", "\n\n", "12345", "😀", "   ", "日本語", "x" * 90]) for _ in range(4000))
    rows = [(1, long), (2, "a" * 3000), (3, " " * 2000 + "b"), (4, None), (5, ""), (6, "hello <|endoftext|>"), (7, "​ x"), (8, long[:64]), (9, long[:65])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in encoding.encode_corpus(df, chunk_chars=64, overlap_chars=32).collect()}
    sizes = {r["doc_id"]: r["n_tokens"] for r in encoding.encode_corpus(df, chunk_chars=64, overlap_chars=32, counts_only=True).collect()}
    for k, t in rows:
        assert got[k] == enc.encode_ordinary(t or "") and sizes[k] == len(got[k])
        assert encoding.decode_ids(got[k]) == (t or "")
    assert encoding.encode_corpus(df.limit(0)).count() == 0


@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 80))
@settings(max_examples=80, deadline=None)
def test_first_fit_decreasing_equals_the_plain_one(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    room: list[int] = []
    want = []
    for s in sizes:
        i = next((i for i, r in enumerate(room) if r >= s), len(room))
        if i == len(room):
            room.append(capacity)
        room[i] -= s
        want.append(i)
    assert packing.first_fit_decreasing(np.array(sizes, np.int64), capacity).tolist() == want


def test_packing_keeps_every_token(spark):
    rows = [(i, i * 37 % 900) for i in range(300)] + [(1000, 5000), (1001, None), (1002, 0), (1003, 512), (1004, 1024)]
    items = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    caps = spark.createDataFrame([("a", 512), ("b", 1024), ("c", None), ("d", 0)], "model string, capacity_tokens int")
    got = packing.pack(items, caps, group_items=100).collect()
    for model, cap in (("a", 512), ("b", 1024)):
        mine = [r for r in got if r["model"] == model]
        fill, parts = Counter(), {}
        for r in mine:
            fill[r["container_id"]] += r["tokens"]
            parts.setdefault(r["doc_id"], []).append((r["part_no"], r["start_token"], r["tokens"]))
        assert max(fill.values()) <= cap
        for k, n in rows:
            p = sorted(parts[k])
            assert sum(x[2] for x in p) == (n or 0) and [x[1] for x in p] == [cap * i for i in range(len(p))]
            assert len(p) == 1 or n > cap
        assert sum(fill.values()) / (len(fill) * cap) > 0.9
    assert {r["model"] for r in got} == {"a", "b"}
    assert packing.pack(items.limit(0), caps).count() == 0 and packing.pack(items, caps.limit(0)).count() == 0


def test_radix_percentiles_are_exact(spark):
    rng = np.random.default_rng(0)
    values = [*rng.lognormal(3, 2, 400).tolist(), *[5.0] * 50, 0.0, -0.0, -3.5, float("inf"), float("-inf"), float("nan"), None, 1e-310]
    rows = [("a", v) for v in values] + [("b", 1.0), (None, 2.0), ("c", None), ("c", float("nan"))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, x double, extra int")
    qs = (0.0, 0.5, 0.9, 0.99, 1.0)
    got = {(r["g"], r["q"]): r for r in quantiles.radix_percentiles(df, ["g"], "x", qs).collect()}
    hist = quantiles.histogram(df, ["g", "extra"], "x")
    bound = {(r["g"], r["q"]): r for r in quantiles.percentiles_from_histogram(quantiles.merge_histograms(hist, ["g"]), ["g"], qs).collect()}
    short = {(r["g"], r["q"]): r for r in quantiles.radix_percentiles(df, ["g"], "x", qs, rounds=2).collect()}
    for g in ("a", "b", None, "c"):
        x = sorted(v for k, v in rows if k == g and v is not None and v == v)
        for q in qs:
            want = x[max(int(np.ceil(q * len(x))), 1) - 1] if x else None
            assert got[g, q]["value"] == want and got[g, q]["n"] == len(x)
            if want is not None:
                assert bound[g, q]["low"] <= want <= bound[g, q]["high"]
                assert want == short[g, q]["value"] or 0 <= want - short[g, q]["value"] <= short[g, q]["error_bound"]
    assert quantiles.radix_percentiles(df.limit(0), ["g"], "x", qs).count() == 0
    with pytest.raises(ValueError):
        quantiles.radix_percentiles(df.withColumnRenamed("g", "n"), ["n"], "x", qs)


def test_order_of_mapped_doubles():
    x = np.array([-np.inf, -1e300, -2.0, -1e-310, 0.0, 5e-324, 1.0, 1.5, np.inf])
    k = quantiles.to_ordered(x)
    assert (np.diff(k) > 0).all() and (quantiles.from_ordered(k) == x).all()
    assert quantiles.to_ordered(np.array([-0.0]))[0] == quantiles.to_ordered(np.array([0.0]))[0]


def test_flight_keeps_sums_and_probabilities():
    rng = np.random.default_rng(5)
    pi = np.array([0.2] * 10 + [0.5] * 4 + [0.7] * 5)
    took = np.zeros(len(pi))
    for _ in range(4000):
        out = sampling.flight(pi, rng)
        assert abs(out.sum() - pi.sum()) < 1e-9 and ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
        took += out
    assert np.abs(took / 4000 - pi).max() < 0.03


def test_balanced_sample_meets_targets(spark):
    units = [(i, "abc"[i % 3] if i % 10 else "rare") for i in range(900)] + [(5, "a"), (None, "a"), (901, None)]
    df = spark.createDataFrame(units, "ticket_id bigint, topic_group string").repartition(7)
    plans = [(1, "a", 500, 0, 100), (1, "b", 250, 0, 100), (1, "rare", 250, 0, 100), (2, "rare", 100, 200, 500), (2, "none", 100, 1, 500), (2, "c", 333, None, 10), (3, "a", None, 0, 10), (2, "b", 335, 0, 10)]
    p = spark.createDataFrame(plans, "plan_id int, topic_group string, target_permille int, min_rows int, sample_rows int")
    drawn, report = sampling.balanced_sample(df, p, "ticket_id", "topic_group")
    n = Counter((r["plan_id"], r["topic_group"]) for r in drawn.collect())
    assert n[1, "a"] == 50 and n[1, "b"] == 25 and n[1, "rare"] == 25 and n[2, "rare"] == 90
    assert n[2, "c"] in (3, 4) and n[2, "b"] in (3, 4) and n[2, "c"] + n[2, "b"] == 7 and n[3, "a"] == 0
    rows = {(r["plan_id"], r["topic_group"]): r for r in report.collect()}
    assert len(rows) == len(plans) and rows[2, "rare"]["shortfall"] == 110 and rows[2, "none"]["shortfall"] == 50 and rows[1, "a"]["shortfall"] == 0
    assert drawn.distinct().count() == drawn.count()
    drawn, report = sampling.balanced_sample(df.limit(0), p, "ticket_id", "topic_group")
    assert drawn.count() == 0 and report.count() == len(plans)


@pytest.fixture(scope="module")
def model():
    return pii.train_model(None, parts=2, per_line=8)


def test_field_on_other_values(model):
    """Other values in the lines it was trained on; test_held_out_lines.py has other lines."""
    texts_ = labelled_texts(77, 3, [], [])
    found = model.find([t for t, _ in texts_])
    for kind in KINDS:
        hit = miss = extra = 0
        for (_, spans_), got in zip(texts_, found):
            a, b = {s for s in spans_ if s[2] == kind}, {s for s in got if s[2] == kind}
            hit, miss, extra = hit + len(a & b), miss + len(a - b), extra + len(b - a)
        assert hit / (hit + miss) > 0.8 and hit / (hit + extra) > 0.85, (kind, hit, miss, extra)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    trans = rng.normal(size=(3, 3)).astype(np.float32)
    lengths = np.array([1, 4, 3, 5])
    emit = rng.normal(size=(13, 3)).astype(np.float32)
    got, at = crf.viterbi(emit, lengths, trans), 0
    for n in lengths:
        e = emit[at : at + n]
        score = lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(got[at : at + n]) == max(itertools.product(range(3), repeat=int(n)), key=score)
        at += n


def test_findings_and_redaction(spark, monkeypatch):
    say = "You can reach me at ann.lee@mail.example or on 07700 900123."
    long = "The tunnel drops after 5 seconds. " * 9000 + say + " All was well again." * 9000
    monkeypatch.setattr(pii, "HOT_ROWS", 2)  # repeated segments are salted
    for setting in ("PARTS", "PER_LINE"):
        monkeypatch.setattr(pii, setting, 4)
    rows = [(1, say), (1, say), (2, None), (3, ""), (4, "Nothing here.\n\n" + say + "\n---\nEnd."), (5, long), (None, say)]
    df = spark.createDataFrame([(*r, 9, "q") for r in rows], "row_key bigint, text string, pos int, h string")
    got = {tuple(r) for r in pii.find_pii(df, ["row_key"], "text").collect()}
    assert got == {(k, kind, t) for k in (1, 4, 5) for kind, t in (("email", "ann.lee@mail.example"), ("phone", "07700 900123"))}
    rows_out = pii.redact_column(df, ["row_key"], "text").collect()
    assert len(rows_out) == sum(k is not None for k, _ in rows)
    clean = {r["row_key"]: r["redacted"] for r in rows_out}
    assert clean[1] == "You can reach me at [EMAIL] or on [PHONE]." and clean[2] is None and clean[3] == ""
    assert clean[4] == "Nothing here.\n\nYou can reach me at [EMAIL] or on [PHONE].\n---\nEnd."
    assert pii.find_pii(df.limit(0), ["row_key"], "text").count() == 0
    assert pii.redact_column(df.limit(0), ["row_key"], "text").count() == 0
    many = spark.range(pii.MAX_NAMES + 1).select(F.col("id").cast("string").alias("name_text"), F.lit("given").alias("name_kind"))
    with pytest.raises(ValueError):
        pii.name_features(many)


def test_windows_find_what_the_whole_text_holds(model, monkeypatch):
    rng = random.Random(8)
    made = [t for t, _ in labelled_texts(5, 1, [], [])]
    text = "\n\n".join(rng.choice(made) for _ in range(150))
    whole = model.find([text, "", "x"])
    monkeypatch.setattr(pii, "WINDOW", 1500)
    monkeypatch.setattr(pii, "MARGIN", 600)
    assert model.find([text, "", "x"]) == whole and len(whole[0]) > 50


def test_quiet_margin_outweighs_transitions(model):
    free = model.trans[model.trans > -1000]
    assert 4 * abs(free).max() < pii.QUIET


def test_nothing_ends_inside_a_run_of_letters_and_digits(model):
    for t in ("serial SN645727B0 again", "passport X12345678Z9 or so", "call 5550123456789x now"):
        assert all((a == 0 or not t[a - 1].isalnum()) and (b == len(t) or not t[b].isalnum()) for a, b, _ in model.find([t])[0])


def test_queries_on_the_smallest_tables(spark, data):
    from lanternq.llm import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())
    for name, columns in {"p1_found": ["id_a", "id_b"], "p2_found": ["id_a", "id_b"], "p4_found": ["plan_id", "topic_group"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id_a", "doc_id_b"]}.items():
        assert queries.queries()[name](spark, data).columns == columns


def test_batches_keep_rows_and_bound_characters():
    import pandas as pd

    f = pd.DataFrame({"t": ["a" * 5, None, "b" * 50, "c", "d" * 6, ""] * 3, "i": range(18)})
    got = list(hashing.batches([f], 4, "t", 10))
    assert pd.concat(got)["i"].tolist() == list(range(18)) and all(len(g) <= 4 for g in got)
    assert all(len(g) == 1 or g["t"].str.len().fillna(0).sum() <= 10 for g in got)
    assert [len(g) for g in hashing.batches([f], 7)] == [7, 7, 4]
