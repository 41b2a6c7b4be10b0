"""Operators of the llm subpackage against brute force, exact round trips and held-out accuracy."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lociframe.llm.containers import fill_containers, pack
from lociframe.llm.mixing import capped_mean, mix_sources, poisson_cdf
from lociframe.llm.pieces import balanced_cuts, cut_kind, furthest_cuts, most_balanced_cuts, split_sequences
from lociframe.llm.language import LANGUAGES, TRIGRAMS, language_of, language_weights, trigram_buckets
from lociframe.llm.reading import body_of, cross_validated, fit_ordinal, reading_levels
from lociframe.llm.components import components
from lociframe.llm.shared_spans import records, shared_clusters, shared_shares, shared_spans

SPAN = 50


def brute_spans(rows):
    """rows: (table, id, name, seq)"""
    names, clean = defaultdict(set), []
    for t, i, n, s in rows:
        s = "" if s is None else re.sub(r"\s", "", s).translate(str.maketrans("acgt", "ACGT"))
        clean.append((t, i, n if n is not None else (t, i), s))
    windows = lambda s: [p for p in range(len(s) - SPAN + 1) if re.fullmatch("[ACGT]+", s[p : p + SPAN])]
    for _, _, n, s in clean:
        for p in windows(s):
            names[s[p : p + SPAN]].add(n)
    out = set()
    for t, i, _, s in clean:
        shared = sorted({q for p in windows(s) if len(names[s[p : p + SPAN]]) > 1 for q in range(p, p + SPAN)})
        k = 0
        while k < len(shared):
            j = k
            while j + 1 < len(shared) and shared[j + 1] == shared[j] + 1:
                j += 1
            out.add((t, i, shared[k], shared[j] + 1))
            k = j + 1
    return out


def test_shared_spans_equal_brute_force(spark):
    rng = random.Random(5)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pool = [dna(300) for _ in range(4)]
    rows = []
    for i in range(60):
        p = rng.choice(pool)
        a = rng.randrange(200)
        s = dna(rng.randrange(60)) + p[a : a + rng.choice([49, 50, 51, 100])] + dna(rng.randrange(60))
        if rng.random() < 0.3:
            k = rng.randrange(len(s))
            s = s[:k] + rng.choice(["N", "\n", " n ", "é"]) + s[k:]
        rows.append((i, rng.choice(["a", "b", "c", None, f"n{i}"]), s.lower() if rng.random() < 0.2 else s))
    rows += [(100, "x", "A" * 200), (101, "y", "A" * 120), (102, "z", "AC" * 90), (103, "z2", "AC" * 40), (104, "e", ""), (105, "f", None), (106, "g", "ACGT"), (107, "x", "A" * 60)]
    rows += [(200 + k, f"h{k}", pool[0]) for k in range(30)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "read_id bigint, name string, seq string, sketch string")
    recs = records(df, "t", "read_id")
    got = [tuple(r) for r in shared_spans(recs).collect()]
    want = brute_spans([("t", *r) for r in rows])
    assert set(got) == want and len(got) == len(want)
    hot = [tuple(r) for r in shared_spans(recs, hot=5).collect()]  # most sketches and windows are hot then
    assert set(hot) == want and len(hot) == len(want)
    shares = {r.rec_id: r for r in shared_shares(recs, shared_spans(recs)).collect()}
    assert shares[100].share == 1.0 and shares[104].share is None and len(shares) == len(rows)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + rng.randrange(40), 1000 + rng.randrange(40)) for _ in range(30)] + [(5000, 5000 + i) for i in range(1, 80)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_clusters_of_shared_records(spark):
    rng = random.Random(12)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b, c = dna(60), dna(60), dna(60)
    rows = [(1, "r1", dna(20) + a), (2, "r2", a + dna(10) + b), (3, "r3", b + dna(5)), (4, "r4", c), (5, "r5", dna(80)), (6, "r4", c), (7, "r7", None)]
    out = {r.rec_id: r for r in shared_clusters(records(spark.createDataFrame(rows, "read_id bigint, name string, seq string"), "t", "read_id")).collect()}
    assert out[1].cluster == out[2].cluster == out[3].cluster and out[4].cluster == out[6].cluster
    assert len({out[i].cluster for i in (1, 4, 5, 7)}) == 4 and out[5].links == 0 and out[2].links >= 1


def test_links_count_all_names_that_share_a_window(spark):
    rng = random.Random(13)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    common, other = dna(70), dna(70)
    rows = [(i, f"n{i}", dna(rng.randrange(30)) + common + dna(9)) for i in range(40)] + [(40, "n40", common + dna(8) + other)] + [(41 + i, f"m{i}", other + dna(i)) for i in range(7)] + [(60, "n3", dna(60))]
    recs = records(spark.createDataFrame(rows, "read_id bigint, name string, seq string"), "t", "read_id")
    for hot in (1 << 16, 8):
        links = {r.rec_id: r.links for r in shared_clusters(recs, hot=hot).collect()}
        assert links == {i: 40 for i in range(40)} | {40: 47} | {41 + i: 7 for i in range(7)} | {60: 40}


def test_shared_spans_of_an_empty_table(spark):
    df = spark.createDataFrame([], "read_id bigint, name string, seq string")
    assert shared_spans(records(df, "t", "read_id")).collect() == []


def test_shared_spans_across_slices(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("ACGT") for _ in range(600_000))
    rows = [(1, "long", long), (2, "at the edge", long[(1 << 18) - 30 : (1 << 18) + 40]), (3, "end", long[-50:])]
    got = {tuple(r)[1:] for r in shared_spans(records(spark.createDataFrame(rows, "read_id bigint, name string, seq string"), "t", "read_id")).collect()}
    assert got == {(1, (1 << 18) - 30, (1 << 18) + 40), (1, 599_950, 600_000), (2, 0, 70), (3, 0, 50)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 900), st.sampled_from([10, 12, 40, 250])), max_size=12), st.integers(0, 1500))
def test_cuts_stay_under_the_limit_and_keep_all(gaps, rest):
    runs, at = [], 0
    for gap, size in gaps:
        runs.append((at + gap, at + gap + size))
        at += gap + size
    length, limit, overlap = at + rest, 400, 20
    begin, ends = 0, [*balanced_cuts(length, runs, limit, overlap), (length, None)]
    for end, natural in ends:
        assert begin <= end and end - begin <= limit
        if natural:
            assert any(a <= end <= b for a, b in runs)
        begin = end - overlap
    stretches = [b - a for a, b in zip([0, *[b for _, b in runs]], [*[a for a, _ in runs], length])]
    if length > limit and max(stretches) <= limit - overlap - 260:
        assert all(natural is not False for _, natural in ends)


@given(st.integers(8, 20), st.integers(0, 5), st.lists(st.tuples(st.integers(1, 30), st.integers(1, 3)), max_size=8), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_no_cuts_have_fewer_forced_ones(limit, overlap, spaced, rest):
    overlap, runs, at = min(overlap, limit // 3), [], 0
    for gap, size in spaced:
        runs.append((at + gap, at + gap + size))
        at += gap + size
    length = at + rest
    natural = {p for a, b in runs for p in range(a, b + 1)}
    least = {}
    for begin in range(length, -1, -1):
        least[begin] = 0 if length - begin <= limit else min((p not in natural) + least[p - overlap] for p in range(begin + overlap + 1, begin + limit + 1))
    edges = [0, *[x for run in runs for x in run], length]
    kind = "forced" if any(b - a > limit for a, b in zip(edges[::2], edges[1::2])) else "natural"
    for way in (balanced_cuts, furthest_cuts, most_balanced_cuts):
        cuts = way(length, runs, limit, overlap) if length > limit else []
        begin = 0
        for end, _ in [*cuts, (length, None)]:
            assert 0 < end - begin <= limit
            begin = end - overlap
        assert sum(not n for _, n in cuts) == least[0]
        assert not cuts or cut_kind(cuts, length, runs, limit) == kind


def test_pieces_are_balanced_where_boundaries_allow_it():
    runs = [(a, a + 20) for a in range(80, 10_100, 100)]
    sizes = lambda cuts: [e - b for b, e in zip([0, *[c - 200 for c, _ in cuts]], [*[c for c, _ in cuts], 10_100])]
    assert min(sizes(balanced_cuts(10_100, runs, 4000, 200))) > 3300
    assert min(sizes(most_balanced_cuts(10_100, runs, 4000, 200))) > 3300
    assert min(sizes(furthest_cuts(10_100, runs, 4000, 200))) < 2700


def test_pieces_join_to_the_sequence(spark):
    rng = random.Random(3)
    seq = lambda n: "".join(rng.choice("ACGTacgt") for _ in range(n))
    rows = [
        (1, "natural", seq(3000) + "N" * 12 + seq(2500) + "n" * 10 + seq(900)),
        (2, "forced", seq(9000)),
        (3, "short", seq(4000)),
        (4, None, seq(2000) + " \n" + "N" * 9 + seq(2500)),
        (5, "empty", ""),
        (6, "null", None),
        (2, "forced", seq(4001)),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "seq_id bigint, name string, seq string, piece string")
    out = split_sequences(df, 4000, 200).collect()
    by = defaultdict(list)
    for r in out:
        by[r.seq_id].append(r)
    plain = {i: re.sub(r"\s", "", s) for i, _, s in rows if s is not None and i != 2}
    for i, s in plain.items():
        parts = sorted(by[i], key=lambda r: r.piece_no)
        assert "".join([parts[0].piece, *[p.piece[200:] for p in parts[1:]]]) == s
        assert all(len(p.piece) <= 4000 for p in parts)
    kinds = {i: {r.cut_kind for r in rs} for i, rs in by.items()}
    assert kinds == {1: {"natural"}, 2: {"forced"}, 3: {None}, 4: {"forced"}, 5: {None}}
    assert all(r.ends_at != "forced" for r in by[1]) and 6 not in by
    assert by[4][0].piece_name.startswith("4:")


def test_pack_is_feasible_and_full():
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 300, 2048, rng.randrange(1, 600), rng.randrange(1, 1000)]) for _ in range(3000)]
    bins = pack(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= math.ceil(sum(sizes) / 2048) * 1.03 + 1
    assert pack([], 10) == [] and pack([0, 0], 10) == [[0, 1]]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=9))
def test_first_bin_is_the_fullest_with_the_largest(sizes):
    bins = pack(sizes, 12)
    if bins and max(sizes, default=0):
        first = max(range(len(sizes)), key=lambda i: (sizes[i]))
        rest = sorted(sizes)[:-1]
        reach = {sizes[first]}
        for s in rest:
            reach |= {r + s for r in reach if r + s <= 12}
        assert sum(sizes[i] for i in bins[0]) == max(reach)


def test_containers_keep_every_document(spark):
    rows = [(i, "word " * (i % 90), "x") for i in range(400)] + [(1000, "long text here " * 900, "y"), (1001, None, "y"), (1002, "", "y"), (5, "again", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, container_id string")
    out = fill_containers(df, 64).collect()
    used, pieces = Counter(), defaultdict(list)
    for r in out:
        used[r.container_id] += r.token_end - r.token_start
        pieces[r.doc_id].append((r.piece_no, r.token_start, r.token_end))
    assert max(used.values()) <= 64 and None not in used
    assert set(pieces) == {r[0] for r in rows}
    long = sorted(pieces[1000])
    assert long[0][1] == 0 and all(a[2] == b[1] for a, b in zip(long, long[1:])) and all(e - s == 64 for _, s, e in long[:-1])
    assert len(pieces[5]) == 2  # two rows, one id
    assert sum(used.values()) / (len(used) * 64) > 0.97
    assert fill_containers(spark.createDataFrame([], "doc_id bigint, text string"), 64).collect() == []


def test_capped_poisson_has_the_wanted_mean():
    for rate, cap in [(0.3, 1), (1.5, 2), (2.9, 3), (0.01, 5), (7.0, 40)]:
        assert abs(sum(1 - p for p in poisson_cdf(capped_mean(rate, cap), cap)) - rate) < 1e-6
    assert poisson_cdf(capped_mean(3, 3), 3) == [0, 0, 0] and poisson_cdf(capped_mean(0, 3), 3) == []


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(4)
    docs = [(i, "word " * rng.randrange(5, 60), "big" if i % 3 else "small", 1) for i in range(3000)]
    docs += [(9000 + i, "tiny text", "tiny", 1) for i in range(10)] + [(9100, None, "big", 1), (9101, "no source", None, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, mix_key int")
    targets = spark.createDataFrame([("big", 0.3, 2), ("small", 0.6, 5), ("tiny", 0.1, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mix_sources(df, targets)
    rep = {r.source: r for r in report.collect()}
    assert abs(rep["big"].share_of_goal - 0.3) < 0.003 and abs(rep["small"].share_of_goal - 0.6) < 0.003
    assert rep["small"].most_used <= 5 and rep["big"].most_used <= 2
    assert not rep["tiny"].reachable and rep["tiny"].mixed_tokens == 3 * rep["tiny"].tokens
    assert rep["absent"].reachable and rep["absent"].mixed_tokens == 0
    rows = mixed.collect()
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows)
    assert [r.mix_key for r in rows] == sorted(r.mix_key for r in rows)
    empty = mix_sources(df.limit(0), targets)[1].collect()
    assert len(empty) == 4 and all(r.mixed_tokens == 0 and r.actual_share is None for r in empty)


def test_ordinal_fit_recovers_levels():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    latent = x @ np.array([3.0, -2.0, 0.0]) + rng.logistic(size=2000)
    y = np.digitize(latent, [-3, 0, 4]) + 1
    w, t = fit_ordinal(x, y, 4)
    assert np.allclose(w, [3, -2, 0], atol=0.4) and np.allclose(t, [-3, 0, 4], atol=0.6)


def test_body_leaves_headnotes_and_page_headers_out():
    text = "Court\nNo. 1-2\nHeadnotes:\nhard words\n\nPara. 1: The cat sat\n[Page 2/2]\non it.\nPara. 2: It left.\n\n3\nCourt\n and ran.\n\nCosts reserved.\nSigned: X"
    assert body_of(text) == "The cat sat\non it.\nIt left.\n and ran."
    assert body_of("no paragraphs") == "" and body_of("§1 One\n§2 Two") == "One\nTwo"


def test_levels_of_graded_text(spark):
    rng = random.Random(6)
    plain = "the cat sat on a mat and the dog ran to the house".split()
    hard = "the notwithstanding jurisdictional misrepresentation of intermediate authorisation that presupposed which".split()

    def text(level):
        sentences = []
        for _ in range(12):
            words = [rng.choice(hard if rng.random() < (level - 1) / 3 else plain) for _ in range(4 + 4 * level)]
            sentences.append(" ".join(words) + ("." if level < 3 else ", and so on; it was."))
        return "Court\n\n1. " + " ".join(sentences)

    truth = {i: rng.randrange(1, 5) for i in range(400)}
    rows = [(i, text(k), "x") for i, k in truth.items()] + [(900, None, "x"), (901, "", "x"), (902, "1. Der Hof und die Frist war nicht offen und der Zaun blieb", "x")]
    grades = [(i, "r", truth[i] if rng.random() < 0.9 else max(1, truth[i] - 1)) for i in range(0, 400, 2)] + [(1, "s", None), (3, "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    graded = spark.createDataFrame(grades, "doc_id bigint, reader string, reading_level int")
    out = {r.doc_id: r for r in reading_levels(docs, graded).collect()}
    held = [i for i in truth if i % 2]
    assert sum(out[i].level == truth[i] for i in held) / len(held) > 0.9
    assert all(out[i].level is None for i in (900, 901, 902)) and len(out) == len(rows)
    assert all(r.level is None for r in reading_levels(docs, graded.limit(0)).collect())
    folds = cross_validated(docs, graded).collect()
    assert len(folds) == 5 and sum(r.grades for r in folds) == 200 and sum(r.exact * r.grades for r in folds) / 200 > 0.8


def test_language_by_trigrams():
    rng = random.Random(14)
    words = {
        "en": "the court held that neither party was entitled to damages which had been claimed before hearing".split(),
        "de": "das gericht hat entschieden dass keine der parteien einen anspruch auf ersatz gegen über früher hätte".split(),
        "fr": "le tribunal a jugé que aucune des parties ne pouvait réclamer cette indemnité pendant les débats".split(),
    }
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    noisy = lambda lang: "en" if lang != "en" and rng.random() < 0.2 else lang
    counts = np.zeros((len(LANGUAGES), TRIGRAMS))
    for _ in range(300):
        lang = rng.choice(LANGUAGES)
        counts[LANGUAGES.index(noisy(lang))] += np.bincount(trigram_buckets(text(lang, 60)), minlength=TRIGRAMS)
    weights = language_weights(counts)
    assert all(LANGUAGES[language_of(text(lang, 25), weights)] == lang for lang in LANGUAGES for _ in range(50))
    assert language_of("zqx jkw vvq xxj qqk wzx", weights) == len(LANGUAGES)  # none of them
    counts[1] = 0
    assert language_of(text("de", 25), language_weights(counts)) != 1
