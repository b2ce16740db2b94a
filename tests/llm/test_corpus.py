"""Corpus operators against brute force, on small tables with the awkward cases in them."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventlens.llm import ann, fingerprint, language, licenses, line_dedup, mixing, near_dedup, packing, quality, url_reputation
from eventlens.llm._shingles import shingles, word_hashes

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use inside, as extra columns of the input.
CLASH = "part int, key int, size int, node int, rank int, copies int, c int, v int, donor int, host int, score int, __gone int, n_deleted int"
SYLLABLES = "ba ko ri ten mu sal do pe lin gra vo shi".split()


def invented(rnd, n, words=None):
    word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4)))
    return " ".join(word() for _ in range(n))


def documents(seed=1, many=120):
    """Texts with nulls, blanks, copies, near copies, long ones and shared lines."""
    rnd = random.Random(seed)
    texts = [None, "", "   \n \t", "one", "Two words", "ÀÉ ß 東京 😀", "a" * 3000]
    while len(texts) < many:
        kind = rnd.random()
        real = [t for t in texts if t and len(t) > 60]
        if kind < 0.15 and real:
            texts.append(rnd.choice(real))
        elif kind < 0.4 and real:
            words = rnd.choice(real).split(" ")
            words[rnd.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        else:
            texts.append("\n".join(invented(rnd, rnd.randint(1, 40)) for _ in range(rnd.randint(1, 6))))
    texts.append(invented(rnd, 8000))
    return texts


@pytest.fixture(scope="module")
def texts():
    return documents()


def frame(spark, rows, schema="doc_id long, text string, lang string, source string", clash=True):
    df = spark.createDataFrame(rows, schema)
    if clash:
        for name in (x.split()[0] for x in CLASH.split(", ")):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(7))
    return df.repartition(3)


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 3 else None, ["b", "a", None][k % 3]) for k, t in enumerate(texts)]
    return frame(spark, rows).cache()


def empty(spark):
    return frame(spark, [])


# --- nearest neighbours ---------------------------------------------------------------
def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((3000, 24))
    base[100:130] = base[100] + 0.01 * rng.standard_normal((30, 24))
    base[200:215] = base[200]  # ties
    rows = [(k, x.tolist(), 1) for k, x in enumerate(base)]
    bad = [(5000, None, 1), (5100, [0.0] * 24, 1), (5200, [float("nan")] * 24, 1), (5300, [None] * 24, 1), (5400, [1.0] * 5, 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, r int").repartition(5)
    got = defaultdict(list)
    for r in ann.search(ann.build_index(df), df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    exact = base.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        assert [r for r, *_ in got[q]] == list(range(1, 11))
        hits += len(set(want.tolist()) & {v for _, v, _ in got[q]})
        assert all(abs(s - d[v]) < 1e-9 for _, v, s in got[q])
    assert hits / 300 > 0.97 and set(got) == set(range(0, 3000, 100))
    assert [v for _, v, _ in got[200]][:5] == [201, 202, 203, 204, 205]


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal((20, 64))
    centre, turn = x.mean(0), ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    guess, width = ann.estimate(*ann.encode(x, centre, turn), q, centre, turn)
    true = ((x[:, None] - q[None]) ** 2).sum(-1)
    assert (np.abs(guess - true) <= width).mean() > 0.97
    assert abs((guess - true).mean()) < 0.5


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = ann.search(ann.build_index(df), df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in rows] == [(0, 1, 100), (0, 2, 100), (0, 3, 1), (100, 1, 0), (100, 2, 1)]
    none = df.where("false")
    assert ann.search(ann.build_index(none), none).collect() == []


# --- mixing ---------------------------------------------------------------------------
def water(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    """Targets by sharing the excess of full sources again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full, free = share * sum(sizes.values()), {}, set(order)
    while free:
        rest = total - sum(full.values())
        each = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if each[s] > limit * sizes[s]]
        if not over:
            return {**full, **each}
        for s in over:
            full[s] = limit * sizes[s]
            free.discard(s)
    return full


def test_mix_meets_targets(spark):
    rnd = random.Random(4)
    rows = [(k, invented(rnd, rnd.choice([0, 1, 5, 30, 200])), "en", rnd.choice(["hot"] * 6 + ["b", "Z", "é", None])) for k in range(4000)]
    rows += [(9999, None, "en", "b")] + [(8888, "same words here", "en", "b")] * 5
    df = frame(spark, rows)
    out = mixing.balanced_mix(df).collect()
    again = mixing.balanced_mix(df.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += count(t)
    want = water(sizes)
    taken = Counter()
    for r in out:
        taken[source[r.doc_id]] += r.taken
        assert r.taken <= 2 * r.size and r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
    assert len(out) == len(rows)
    for s, target in want.items():
        assert abs(taken[s] - target) <= 0.01 * target + 2, s


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 1000, 500)
    chance = np.full(500, 0.37)
    moved = mixing.flight(chance, size, np.arange(500))
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert moved.sum() == pytest.approx(chance.sum()) and moved @ size == pytest.approx(chance @ size)
    even = mixing.flight(chance, np.ones(500), np.arange(500))
    assert even.sum() == pytest.approx(chance.sum()) and ((even > 0) & (even < 1)).sum() <= 2
    often = np.mean([mixing.flight(np.full(9, 1 / 3), np.arange(1, 10), rng.integers(0, 1 << 62, 9)) for _ in range(2000)], axis=0)
    assert np.abs(often - 1 / 3).max() < 0.05


def test_mix_rows(spark, docs):
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.copies for r in mixing.balanced_mix(docs).collect()}
    sized = {r.doc_id: r.n for r in docs.select("doc_id", mixing.words().alias("n")).collect()}
    rows = Counter(r.doc_id for r in mixed.collect())
    assert all(rows[k] == (taken[k] if sized[k] else 1) for k in taken)
    assert mixing.balanced_mix(empty(spark)).collect() == [] and mixing.apply_mix(empty(spark)).collect() == []
    blank = frame(spark, [(1, "", "en", "a"), (2, None, "en", None)])
    assert [r.taken for r in mixing.balanced_mix(blank).collect()] == [0, 0]


# --- fingerprints ---------------------------------------------------------------------
def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_shingles_match_a_plain_count(texts):
    for text, s in zip(texts, shingles([t or "" for t in texts]), strict=True):
        assert len(s) == len(plain_shingles(text))
    h, n = word_hashes(["A b", "", "a  B\n", "é"])
    assert n.tolist() == [2, 0, 2, 1] and h[0] == h[2] and h[1] == h[3]
    one, two = shingles(["x " * 300_000, "y z " * 10])
    assert len(one) == 1 and len(two) == 2


def test_fingerprints(spark, docs, texts):
    got = {r.doc_id: r for r in fingerprint.fingerprint_with_edits(docs).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(t or "" for t in texts):
        after = texts[(k + 1) % len(texts)] or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        a, b, c = plain_shingles(text), plain_shingles(changed), plain_shingles(after)
        true = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(r.near_edited - true(a, b)) < 0.2 and abs(r.near_next - true(a, c)) < 0.2
        assert len(base64.b64decode(r.fingerprint)) == 8 * min(len(a), fingerprint.K)
        assert abs(r.n_shingles_est - len(a)) <= 0.4 * len(a)
    by_text = defaultdict(set)
    for k, text in enumerate(texts):
        by_text[text or ""].add(got[k].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprint.fingerprint_with_edits(empty(spark)).collect() == []


def test_fingerprint_order_with_nulls_and_one_row(spark):
    rows = [(None, "n u l l", "", ""), (5, "five five five five", "", ""), (5, "aaaa", "", ""), (-3, "minus", "", "")]
    got = fingerprint.fingerprint_with_edits(frame(spark, rows)).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {r.edited_sha256 for r in got} == {digest("n u l m"), digest("minua"), digest("aaaf"), digest("five five five n u ")}
    one = fingerprint.fingerprint_with_edits(frame(spark, [(1, "abcdefgh", "", "")])).collect()
    assert [r.edited_sha256 for r in one] == [digest("abcdefab")]


def test_sketches_merge():
    rnd = random.Random(6)
    a, b = invented(rnd, 3000), invented(rnd, 3000)
    whole, x, y = fingerprint.sketches([f"{a} {b}", f"{a}", f"{b}"])
    joint = fingerprint.sketches([" ".join([*a.split()[-4:], *b.split()[:4]])])[0]
    assert (fingerprint.merge(x, y, joint) == whole).all()
    assert (fingerprint.from_text(fingerprint.to_text(x)) == x).all()
    assert abs(fingerprint.containment(x, whole) - 1) < 0.15 and abs(fingerprint.resemblance(x, whole) - 0.5) < 0.15
    assert abs(fingerprint.distinct(whole) - 6000) < 1800


# --- language -------------------------------------------------------------------------
def spoken(rnd, lang, n):
    parts = {"aa": ["zu", "ke", "wix", "pol"], "bb": ["mar", "eno", "ti", "sul"], "cc": ["dra", "ogg", "unf", "ly"]}[lang]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rnd = random.Random(7)
    rows = [(k, spoken(rnd, lang, rnd.randint(8, 80)), lang, "s") for k in range(300) for lang in [rnd.choice(["aa", "bb", "cc"])]]
    rows += [(1000, None, "aa", ""), (1001, "", "aa", ""), (1002, "123 !?", "bb", ""), (1003, spoken(rnd, "aa", 40), None, "")]
    rows += [(1004, spoken(rnd, "aa", 300) + " " + spoken(rnd, "bb", 200), None, ""), (None, spoken(rnd, "cc", 30), None, "")]
    df = frame(spark, rows)
    held = {k: zlib.crc32(str(k).encode()) % 4 == 2 for k, *_ in rows if k is not None}
    model = language.learn(df.where("doc_id is null or doc_id < 1000").where(~language.held_out()))
    out = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert all(out[k].held_out == held[k] for k in held)
    assert np.mean([out[k].lang_pred == lang for k, _, lang, _ in rows if k is not None and k < 1000 and held[k]]) > 0.97
    assert all((out[k].lang_pred, out[k].score) == ("und", 0.0) for k in (1000, 1001, 1002))
    assert out[1003].lang_pred == "aa" and out[None].lang_pred == "cc"
    assert re.fullmatch(r"aa:0\.(5[5-9]|6\d),bb:0\.(3\d|4[0-5])", out[1004].languages)
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = {r.doc_id for r in language.keep_identified(df, model).collect()}
    assert {1000, 1001, 1002} & kept == set() and 1003 in kept
    nothing = language.learn(empty(spark))
    assert {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"}
    assert language.predict(empty(spark), model).collect() == []


def test_expectation_maximisation_finds_shares():
    rng = np.random.default_rng(8)
    chance = rng.dirichlet(np.full(50, 0.2), 3).T + 1e-6
    counts = np.round(10_000 * (chance @ [0.7, 0.3, 0.0]))
    chosen, parts = language.select(chance, counts)
    assert sorted(chosen) == [0, 1] and abs(parts[chosen.index(0)] - 0.7) < 0.03


# --- urls -----------------------------------------------------------------------------
def test_rules(spark):
    urls = [
        "http://EXAMPLE.com/en/1", "https://www.example.com/en/x?q=/", "http://a.example.com", "http://x.net/es/1", "http://net/fr/", "ftp://notexample.com/en/",
        None, "no scheme", "http://x.org/a#b", "://host?x", "http://x.net/en/http://y.net/es/", "http://com:80/", "http://Ä.NET/es/\nz",
    ]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)] + [(None, "http://x.org", 1)], "page_id long, url string, rule int")
    none = spark.createDataFrame([], "url string, bad int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(pages, none).collect()}
    assert out == {
        0: ("example.com", "/en/1", "example.com/en/", "block"), 1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        2: ("a.example.com", "", None, "allow"), 3: ("x.net", "/es/1", "net/es/", "block"), 4: ("net", "/fr/", "net/fr/", "block"),
        5: ("notexample.com", "/en/", "com/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("x.org", "/a", None, "allow"),
        9: ("host", "", None, "allow"), 10: ("x.net", "/en/http://y.net/es/", None, "allow"), 11: ("com:80", "/", None, "allow"),
        12: ("Ä.net", "/es/\nz", "net/es/", "block"), None: ("x.org", "", None, "allow"),
    }
    assert url_reputation.judge(pages.where("false"), none).collect() == []


def test_reputation_shrinks(spark):
    rows = [("http://bad.spam.org/1", 1)] * 40 + [("http://good.fine.org/1", 0)] * 400 + [("http://other.spam.org/", 1)] * 2 + [("http://worse.spam.org/", 1)] * 30
    rows += [("http://one.solo.org/", 1)] + [(f"http://h{k}.fine.org/", 0) for k in range(30)] + [("http://new.spam.org/", None), (None, 1)]
    outcomes = spark.createDataFrame(rows, "url string, bad int")
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(dict.fromkeys(u for u, _ in rows))], "page_id long, url string")
    out = {r.host: r.verdict for r in url_reputation.judge(pages, outcomes, rules=()).collect()}
    assert out["bad.spam.org"] == out["worse.spam.org"] == "block"
    assert out["good.fine.org"] == out["one.solo.org"] == out["h3.fine.org"] == "allow"
    known, rate = url_reputation.reputation(outcomes.select(url_reputation.host_of().alias("host"), "bad"))
    mean = {r.host: r.alpha / (r.alpha + r.beta) for r in known.collect()}
    assert min(mean["bad.spam.org"], mean["new.spam.org"]) > 0.9 > mean["one.solo.org"] > mean["h3.fine.org"] and 0.1 < rate < 0.2


# --- lines ----------------------------------------------------------------------------
def test_line_dedup(spark):
    rnd = random.Random(9)
    passage = [invented(rnd, 20), invented(rnd, 20), invented(rnd, 20)]
    long_line, short = invented(rnd, 60), invented(rnd, 5)
    own = lambda: [invented(rnd, 12) for _ in range(3)]
    a, b, c, d = own(), own(), own(), own()
    texts = {
        1: [*a, *passage, "", a[0] + " end"], 2: [*b, long_line], 3: [*c[:2], *passage, c[2]], 4: [*d, f"  {long_line}", short],
        5: [short, short, short], 6: [*a, *passage, "", a[0] + " end"], 7: [short, passage[0], "between", passage[1]], 8: own() + passage[:2],
    }
    rows = [(k, "\n".join(v), "en", "s") for k, v in texts.items()] + [(9, None, "", ""), (10, "", "", ""), (None, long_line, "", ""), (11, " \n ", "", "")]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    text = {k: r.text for k, r in got.items()}
    assert text[1] == rows[0][1] and text[3] == "\n".join(c) and text[6] == "" and got[6].n_deleted == 7
    assert text[2] == "\n".join(b) and text[4] == "\n".join([*d, short])  # the row without an id comes first
    assert text[5] == rows[4][1] and text[7] == rows[6][1] and text[None] == long_line
    assert text[8].count("\n") == 2 and got[8].n_deleted == 2
    assert (text[9], text[10], text[11]) == (None, "", " \n ")
    assert line_dedup.dedup_lines(df).columns == [*[c for c in df.columns if c != "n_deleted"], "n_deleted"]
    assert line_dedup.dedup_lines(empty(spark)).collect() == []


def test_line_dedup_hot_lines_and_repeats(spark):
    rnd = random.Random(10)
    hot = [invented(rnd, 25), invented(rnd, 25)]
    rows = [(k, "\n".join([invented(rnd, 9), *hot, invented(rnd, 9)]), "", "") for k in range(200)]
    rows += [(500, "\n".join([*hot, "x", *hot, "y", *hot]), "", "")] + [(600, rows[7][1], "", "")] * 2
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()]
    first = rows[0][1]
    assert dict(got)[0] == first and all(hot[0] not in t and hot[1] not in t for k, t in got if k)
    assert dict(got)[500] == "x\ny" and [t for k, t in got if k == 600] == ["", ""]
    assert all(len(t.split("\n")) == 2 for k, t in got if 0 < k < 200)


@pytest.mark.parametrize("length", [1, 3, 5, 8, 12, 25])
def test_line_dedup_deletes_runs_to_their_ends(spark, length):
    """Whatever the lines' length, and though parts of the passage stand earlier."""
    rnd = random.Random(length)
    passage = [invented(rnd, length) for _ in range(-(-60 // length))]
    own = {k: [invented(rnd, 7), invented(rnd, 9)] for k in range(6)}
    part = passage[len(passage) // 4 : -(len(passage) // 4)]
    texts = {0: [own[0][0], *part, own[0][1]]} | {k: [own[k][0], *passage, own[k][1]] for k in range(1, 6)}
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(frame(spark, [(k, "\n".join(v), "", "") for k, v in texts.items()])).collect()}
    assert got[0] == texts[0] and all(got[k] == own[k] for k in range(2, 6))


def test_line_dedup_is_exact(spark):
    """A line goes if and only if it is in a run of MIN_WORDS words that stands earlier."""
    rnd = random.Random(21)
    lines = [invented(rnd, rnd.choice([1, 2, 4, 7, 13, 24, 30])) for _ in range(25)]
    texts = {k: [rnd.choice(lines) for _ in range(rnd.randint(1, 25))] for k in range(80)}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, [(k, "\n".join(v), "", "") for k, v in texts.items()])).collect()}
    seen: set[tuple[str, ...]] = set()
    for k, own in texts.items():
        gone = set()
        for a in range(len(own)):
            for b in range(a, len(own)):
                run = tuple(own[a : b + 1])
                if sum(len(x.split()) for x in run) >= line_dedup.MIN_WORDS:
                    gone |= set(range(a, b + 1)) if run in seen else set()
                    seen.add(run)
        assert got[k] == "\n".join(x for i, x in enumerate(own) if i not in gone), k


# --- licenses -------------------------------------------------------------------------
LICENSED = [
    None, "", "CC BY", "cc-by cc  by, Cc/BY accby", "It is the GNU General\nPublic  License. All rights reserved!", "all rights not reserved",
    "x y. Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "licensed under Apache license version 2",
    "the license under apache", "ccÉ by", "cc byé", "All rights reserved. all rights reserved", "Licensed under CC BY-NC 4.0.", "İ K general public license",
]


def test_licenses(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(LICENSED)] + [(99, LICENSED[2] + "\n" + "word " * 20_000 + "cc by", "", "")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for k, text, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            places = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += places
            labels |= {label} if places else set()
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)),
        ), text
        # every template against every block, in full
        best = 0.0
        for block in re.split(r"[\r\n]+|(?<=[.!?;])[ \t]+", text or ""):
            own = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", block)}
            for label, template in licenses.TEMPLATES:
                t = set(template.split())
                if len(t & own) >= math.ceil(licenses.THRESHOLD * len(t) - 1e-9):
                    labels.add(label)
                    best = max(best, len(t & own) / len(t))
        assert r.labels == ",".join(sorted(labels)) and r.score == pytest.approx(1.0 if at else best), text
    assert licenses.scan(empty(spark)).collect() == []


def test_wrapped_licenses(spark):
    """Notices over several lines, wrapped as usual, narrowly and as comments; not words that are scattered."""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one."
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    narrow = lambda t, start="": "\n".join(start + w for w in t.split())
    rows = {}
    for k, (text, label) in enumerate([(bsd, "bsd"), (mpl, "mpl-2.0"), (gpl, "gpl"), ("some code\nAll rights\r\nreserved.", "reserved")]):
        around = "x = 1\n\n" + text + "\n\nimport y"
        for j, whole in enumerate([text, around, narrow(text), "/*\n" + narrow(text, " * "), "# " + text.replace("\n", "\n# "), text.replace("\n", "\r\n")]):
            rows[10 * k + j] = (whole, label)
    scattered = "all of us\nhave some rights here\nand seats that are reserved"
    apart = "released under\n \nthe mit license"
    rows |= {90: (scattered, ""), 91: (apart, ""), 92: ("\n".join(w + " filler text" for w in bsd.split()), "")}
    got = {r.doc_id: r for r in licenses.scan(frame(spark, [(k, t, "", "") for k, (t, _) in rows.items()])).collect()}
    assert {k: r.labels for k, r in got.items()} == {k: label for k, (_, label) in rows.items()}
    assert got[0].score == got[10].score == 1.0 and got[90].score == 0.0


# --- quality --------------------------------------------------------------------------
def test_quality(spark):
    rnd = random.Random(11)
    rows, labels = [], []
    for k in range(600):
        good = rnd.random() < 0.6
        text = invented(rnd, rnd.randint(20, 60))
        rows.append((k, text if good else rnd.choice([text.upper(), " ".join([text.split()[0]] * 40), text.replace(" ", "## ")]), "en", "s"))
        labels.append((k, int(good), 0))
    rows += [(1000, None, "", ""), (1001, "", "", ""), (None, "fine words", "", "")]
    labels += [(0, None, 0), (5, 0, 0), (None, 1, 0), (7777, 1, 1)]
    df, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = quality.fit(df, marks)
    out = {r.doc_id: r for r in quality.classify(df, weights).collect()}
    right = [out[k].predicted == y for k, y, _ in labels[:600] if out[k].held_out and k != 5]
    assert len(right) > 100 and np.mean(right) > 0.95
    assert out[1000].score == out[1001].score and all(0 <= r.score <= 1 for r in out.values()) and None in out
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in out.items() if k is not None)
    again = quality.fit(df.repartition(5), marks.repartition(3))
    assert np.array_equal(weights, again)
    assert {r.score for r in quality.classify(df, quality.fit(df, marks.where("false"))).collect()} == {0.5}
    assert quality.classify(empty(spark), weights).collect() == []


def test_quality_bound_and_fold(spark):
    rnd = random.Random(12)
    rows = [(k, invented(rnd, 20), "", "") for k in range(100)]
    marks = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    learned = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2]
    df = frame(spark, rows)
    assert np.array_equal(quality.fit(df, marks), quality.fit(df.where(F.col("doc_id").isin(learned)), marks))
    assert not np.array_equal(quality.fit(df, marks, fit_rows=10), quality.fit(df, marks))


# --- near duplicates ------------------------------------------------------------------
def components(texts):
    """By comparing all pairs of shingle sets."""
    sets = {k: plain_shingles(t) for k, t in texts.items()}
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


def near_copies(rnd, many):
    """A chain of texts, each a few edits from an earlier one, some more than others."""
    texts = {0: invented(rnd, 150)}
    for k in range(1, many):
        words = texts[rnd.randrange(max(0, k - 6), k)].split()
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = invented(rnd, 1)
        texts[k] = " ".join(words)
    return texts


@pytest.mark.parametrize("options", [{}, {"leaf": 4, "depth": 2}])
def test_near_duplicates(spark, texts, options):
    rnd = random.Random(13)
    every = dict(enumerate(texts))
    every |= {1000 + k: t for k, t in near_copies(rnd, 150).items()}
    every |= {2000 + k: invented(rnd, 60) + " " + invented(random.Random(1), 60) for k in range(30)}
    df = frame(spark, [(k, t, "", "") for k, t in every.items()])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.link_documents(df, **options).collect()}
    want = components(every)
    assert got == {k: (n, c, c == k) for k, (n, c) in want.items()}


def test_near_duplicates_of_odd_rows(spark):
    long = invented(random.Random(14), 50)
    rows = [(1, long, "", ""), (1, long, "", ""), (None, long, "", ""), (2, long.upper(), "", ""), (3, None, "", ""), (4, "", "", ""), (5, "a b", "", ""), (6, "A  B", "", "")]
    df = frame(spark, rows)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.link_documents(df).collect()), key=repr)
    n = len(plain_shingles(long))
    want = [(1, n, 1, True), (1, n, 1, True), (2, n, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (None, n, None, True)]
    assert got == sorted(want, key=repr)
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 1, 3, 4, 5, None], key=repr)
    assert near_dedup.link_documents(empty(spark)).collect() == []


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    assert {(r.v, r.c) for r in near_dedup.components(path).collect()} == {(k, 0) for k in range(61)} | {(100, 100), (200, 100)}


# --- packing --------------------------------------------------------------------------
def test_pack_is_whole_and_full():
    rnd = random.Random(15)
    for case in ([], [1], [5000], [2048], [256] * 40, [rnd.randint(1, 4000) for _ in range(300)], [rnd.randint(1, 200) for _ in range(999)]):
        windows = packing.pack(case)
        spans = defaultdict(list)
        for size, pieces in windows:
            assert sum(n for *_, n in pieces) == size <= 2048 and not size & (size - 1)
            for doc, at, n in pieces:
                spans[doc].append((at, n))
        for doc, n in enumerate(case):
            end = 0
            for at, m in sorted(spans[doc]):
                assert at == end and m > 0
                end += m
            assert end == n
    steps = packing.step_groups(windows, 8192)
    by_group = defaultdict(list)
    for (size, _), g in zip(windows, steps, strict=True):
        by_group[g].append(size)
    assert all(len(set(sizes)) == 1 and sum(sizes) <= 8192 for sizes in by_group.values())


def test_chunk_ids_are_the_tokenizers(texts):
    import pyarrow as pa

    t = Tokenizer.from_file(TOKENIZER)
    rnd = random.Random(16)
    odd = [
        "don't 're''s!! I'LL it's.", "Áb é. Å Ångström", "x y z\x1cw\x85v", "１２ ² ½ Ⅻ 東京。タワー", "<|endoftext|>a <|startoftext|>", "ΣΑΣ. ΟΔΟΣ",
        "İstanbul ǅ ﬁ", "a\x0bb\x0cc\rd", "".join(chr(rnd.randrange(1, 0xD7FF)) for _ in range(3000)), "word,|#. ...", "عربي. हिन्दी, ไทย!", "\u0000a b\u0000",
    ]
    every = [x or "" for x in texts] + odd + [" ".join(odd)]
    got = packing.chunks(TOKENIZER).ids(pa.array(every))
    for text, ids in zip(every, got, strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_packed_documents(spark, docs, texts):
    t = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack_documents(docs, TOKENIZER, block_ids=5000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, text in enumerate(texts):
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and not at & (at - 1) and len({(r.tier, r.step_group) for r in own}) == 1
    assert packing.pack_documents(empty(spark), TOKENIZER).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(docs, TOKENIZER, tiers=(512, 1000))


# --- pipeline -------------------------------------------------------------------------
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(17)
    rows = []
    passage = [invented(rnd, 30), invented(rnd, 30)]
    for k in range(150):
        lang = rnd.choice(["aa", "bb", "cc"])
        rows.append((k, "\n".join(spoken(rnd, lang, rnd.randint(5, 25)) for _ in range(4)), lang, f"s{k % 4}"))
    rows += [(200, rows[3][1], "aa", "s1"), (201, "12 34", "aa", "s1"), (202, None, "bb", None), (203, rows[0][1] + "\n" + "\n".join(passage), "cc", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    current = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, str(tmp_path))
        assert k == 4 or out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        out.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in current.select("doc_id").collect()})
    assert {201, 202} & seen[0] == set() and set(range(150)) <= seen[0]
    assert 200 not in seen[1] and set(range(150)) <= seen[1]
    assert seen[2] == seen[1] and seen[4] == seen[3] <= seen[2]
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    whole = key(corpus_pipeline.run(spark, str(tmp_path)))
    tokens = lambda x: sum(n for _, _, n, _ in x)
    assert tokens(whole) == tokens(key(current)) and {d for d, *_ in whole} == seen[4]


def test_pipeline_links_from_080(spark):
    """The near-dedup stage drops what all pairs of at least 0.80 connect to an earlier document."""
    import corpus_pipeline

    rnd = random.Random(22)
    texts = {}
    for k in range(0, 200, 2):
        words = invented(rnd, 204).split()
        texts[k] = " ".join(words)
        for at in rnd.sample(range(4, 200, 8), rnd.randint(3, 6)):  # a word away from others changes five shingles
            words[at] = "changed" + str(at)
        texts[k + 1] = " ".join(words)
    sets = {k: plain_shingles(t) for k, t in texts.items()}
    share = {k: len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, 200, 2)}
    assert all(not sets[a] & sets[b] for a, b in itertools.combinations(sets, 2) if a // 2 != b // 2)
    assert sum(0.8 <= x < 0.85 for x in share.values()) > 20 and sum(x < 0.8 for x in share.values()) > 10
    got = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, frame(spark, [(k, t, "", "") for k, t in texts.items()]), "").collect()}
    assert got == {k for k in texts if k % 2 == 0 or share[k - 1] < 0.8}


def test_line_dedup_against_brute_force(spark):
    """Runs of SURE_WORDS words that stand earlier never survive whole; what is deleted stands earlier."""
    rnd = random.Random(18)
    lines = [invented(rnd, rnd.choice([1, 3, 8, 15, 26, 40, 70])) for _ in range(60)]
    passages = [[rnd.choice(lines) for _ in range(rnd.randint(2, 12))] for _ in range(12)]
    texts = {}
    for k in range(150):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            parts += rnd.choice([*passages, [invented(rnd, 12)], [rnd.choice(lines)], ["", " "]])
        texts[k] = "\n".join(parts)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, [(k, t, "", "") for k, t in texts.items()])).collect()}
    words = lambda x: len(x.split())
    seen: set[tuple[str, ...]] = set()
    deleted = 0
    for k, text in texts.items():
        own = [x.strip() for x in text.split("\n") if x.strip()]
        kept = [x.strip() for x in got[k].split("\n") if x.strip()]
        # Every kept line in order; what lies between was deleted.
        gone, j = [], 0
        for x in own:
            if j < len(kept) and kept[j] == x:
                j += 1
                gone.append(False)
            else:
                gone.append(True)
        assert j == len(kept)
        deleted += sum(gone)
        for a in range(len(own)):
            for b in range(a, min(len(own), a + 30)):
                run = tuple(own[a : b + 1])
                n = sum(map(words, run))
                if n >= line_dedup.SURE_WORDS and run in seen:
                    assert any(gone[a : b + 1]), (k, a, b)
                seen.add(run)
        if not any(gone):
            assert got[k] == text
    assert deleted > 200


# --- against plain versions -----------------------------------------------------------
def plain_language(model, text):
    """Language, share and set of one text, by loops over its n-grams."""
    bins = Counter(language.grams(text).tolist())
    if not bins:
        return "und", 0.0
    total, many = sum(bins.values()), len(model.languages)

    def mixture(among):
        share = {k: 1 / len(among) for k in among}
        for _ in range(language.ROUNDS):
            gained = dict.fromkeys(among, 0.0)
            for b, n in bins.items():
                whole = sum(share[k] * model.chance[b, k] for k in among)
                for k in among:
                    gained[k] += n * share[k] * model.chance[b, k] / whole
            moved = {k: v / total for k, v in gained.items()}
            change = max(abs(moved[k] - share[k]) for k in among)
            share = moved
            if change < language.CONVERGED:
                break
        return share

    fit = lambda share: sum(n * math.log(sum(p * model.chance[b, k] for k, p in share.items())) for b, n in bins.items())
    free = mixture(range(many))
    order = sorted(free, key=lambda k: (-free[k], k))
    if many == 1 or free[order[1]] < language.LEAST_SHARE:
        return model.languages[order[0]], free[order[0]]
    chosen = [max(range(many), key=lambda k: (fit({k: 1.0}), -k))]
    best = fit({chosen[0]: 1.0})
    for k in order:
        if k not in chosen:
            gained = fit(mixture([*chosen, k]))
            if gained - best <= language.PENALTY * math.log(max(2.0, total)):
                break
            chosen, best = [*chosen, k], gained
    share = mixture(chosen)
    top = max(chosen, key=lambda k: (share[k], -k))
    return model.languages[top], share[top] if len(chosen) > 1 else free[top]


def test_languages_against_a_plain_version(spark):
    rnd = random.Random(31)
    rows = [(k, spoken(rnd, lang, rnd.randint(5, 60)), lang, "s") for k in range(90) for lang in [rnd.choice(["aa", "bb", "cc"])]]
    model = language.learn(frame(spark, rows))
    texts = [None, "", "1 2", "zu", "zu mar"] + [t for _, t, *_ in rows[:30]]
    texts += [" ".join(spoken(rnd, lang, rnd.choice([2, 10, 60])) for lang in rnd.sample(["aa", "bb", "cc"], rnd.randint(2, 3))) for _ in range(60)]
    texts += ["zu ke " * 20_000, texts[40], texts[40]]
    got = language.infer(model, texts)
    for text, (lang, score, _) in zip(texts, got, strict=True):
        want = plain_language(model, text or "")
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-9), text
    alone = [language.infer(model, [t])[0] for t in texts]
    assert alone == got == language.infer(model, texts[::-1])[::-1]  # whatever texts are batched together
    df = frame(spark, [(k, t, None, "") for k, t in enumerate(texts)])
    for parts in (1, 7):
        assert {r.doc_id: (r.lang_pred, r.score, r.languages) for r in language.predict(df.repartition(parts), model).collect()} == dict(enumerate(got))


def test_language_ties_and_too_many(spark, monkeypatch):
    twins = frame(spark, [(k, "same words in both", lang, "") for k, lang in enumerate(["yy", "xx", "yy", "xx"])])
    assert {(r.lang_pred, round(r.score, 6)) for r in language.predict(twins, language.learn(twins)).collect()} == {("xx", 0.5)}
    monkeypatch.setattr(language, "MOST_LANGUAGES", 5)
    many = frame(spark, [(k, "some text", f"l{k}", "") for k in range(9)])
    with pytest.raises(ValueError, match="more than 5"):
        language.learn(many)


def test_quality_against_a_plain_learner(spark):
    """The weights of follow-the-regularised-leader, kept in dictionaries and updated one by one."""
    rnd = random.Random(32)
    rows = [(k, invented(rnd, rnd.randint(1, 30)) if k % 3 else invented(rnd, 8).upper(), "", "") for k in range(120)]
    rows += [(7, "another text of the same id", "", ""), (7, "a third one", "", ""), (200, "", "", ""), (201, None, "", "")]
    marks = [(k, int(k % 3 > 0)) for k in range(120)] + [(200, 1), (201, 0)]
    got = quality.fit(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int"))
    per = {}
    for k, text, *_ in rows:
        if zlib.crc32(str(k).encode()) % 4 != 2:
            bins, values = quality.features(text)
            found = (bins.tobytes(), values.tobytes())
            per[k] = min(per.get(k, found), found)
    hashed = {r.doc_id: r.h for r in spark.createDataFrame([(k,) for k in per], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    labels = dict(marks)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.PASSES):
        for k in sorted(per, key=lambda k: (hashed[k], k)):
            own = dict(zip(np.frombuffer(per[k][0], np.int32).tolist(), np.frombuffer(per[k][1], np.float32).tolist(), strict=True)) | {quality.BINS - 1: 1.0}
            now = {i: weight(i) for i in own}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(now[i] * x for i, x in own.items())))))
            for i, x in own.items():
                g = (p - labels[k]) * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * now[i]
                n[i] += g * g
    want = np.zeros(quality.BINS, np.float32)
    for i in z:
        want[i] = weight(i)
    assert np.abs(want).max() > 0.1 and np.allclose(got, want, atol=1e-4)
    text = rows[1][1]
    assert quality.score(got, text) == pytest.approx(1 / (1 + math.exp(-sum(float(got[b]) * float(v) for b, v in zip(*quality.features(text), strict=True)) - float(got[-1]))), abs=1e-6)
    assert 0 <= quality.score(got, "long " * 300_000) <= 1


def test_licenses_beyond_sixteen_bits(spark):
    texts = ["😀😀😀😀 cc by", "😀 a 😀b cc by c 😀 CC-BY", "cc by 😀", "𝔘𝔫𝔦 general\npublic license 😀 all rights reserved"]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, [(k, t, "", "") for k, t in enumerate(texts)])).collect()}
    assert [(got[k].n_words, got[k].n_base, got[k].first_word, got[k].last_word) for k in range(4)] == [(3, 1, 1, 1), (9, 2, 3, 7), (3, 1, 0, 0), (8, 2, 1, 5)]


def test_registered_domains(spark):
    hosts = {
        "www.bbc.co.uk": ("www.bbc.co.uk", "co.uk", "bbc.co.uk"), "a.b.example.com:8080": ("a.b.example.com", "com", "example.com"), "co.uk": ("co.uk", "co.uk", "co.uk"),
        "10.0.0.1:80": ("10.0.0.1", "(address)", "10.0.0.1"), "[::1]:443": ("[::1]", "(address)", "[::1]"), "localhost": ("localhost", "localhost", "localhost"),
        "u:p@x.github.io.": ("x.github.io", "github.io", "x.github.io"), "y.s3.amazonaws.com": ("y.s3.amazonaws.com", "s3.amazonaws.com", "y.s3.amazonaws.com"), "": ("", "", ""),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("name", url_reputation.name_of(F.col("host")))
    got = df.select("host", "name", url_reputation.suffix_of(F.col("name")).alias("s"), url_reputation.domain_of(F.col("name")).alias("d")).collect()
    assert {r.host: (r.name, r.s, r.d) for r in got} == hosts
    rows = [(f"http://{h}.bad.co.uk:{p}/", 1) for h in "abc" for p in (80, 81) for _ in range(9)] + [(f"http://h{k}.co.uk/", 0) for k in range(60) for _ in range(3)]
    rows += [("http://new.bad.co.uk/", None), ("http://new.co.uk/", None), ("http://" + "long" * 50_000 + ".org/" + "x" * 50_000, 0)]
    outcomes = spark.createDataFrame(rows, "url string, bad int")
    pages = spark.createDataFrame([(k, u, "x") for k, (u, _) in enumerate(rows)], "page_id long, url string, name string")
    verdicts = defaultdict(set)
    for r in url_reputation.judge(pages, outcomes, rules=()).collect():
        verdicts[r.host.split(":")[0]].add(r.verdict)
    # What is known of a registered domain counts for its other hosts, not for other domains below one suffix.
    assert all(verdicts[f"{h}.bad.co.uk"] == {"block"} for h in ("a", "b", "c", "new")) and verdicts["new.co.uk"] == verdicts["h3.co.uk"] == {"allow"}


def test_reputation_of_pages(spark, tmp_path):
    """The query decides both ways where hosts differ, and its bounds are those of a plain computation."""
    from eventlens.llm import queries

    rnd = random.Random(33)
    hosts = [f"h{k}.d{k % 5}.org" for k in range(20)] + ["www.big-casino.org", "spam.d1.org"]
    pages, labels = [], []
    for k in range(900):
        host = rnd.choice(hosts)
        pages.append((k, f"https://{host}/en/{k}.html", ""))
        if rnd.random() < 0.5:
            labels.append((k, int(rnd.random() > (0.9 if host == "spam.d1.org" else 0.1)), 0))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = queries.op5_url_reputation(spark, str(tmp_path)).collect()
    assert {(r.host in ("www.big-casino.org", "spam.d1.org"), r.verdict) for r in out} == {(True, "block"), (False, "allow")}
    bad = {d: 1 - q for d, q, _ in labels}
    count, rate = defaultdict(lambda: [0, 0]), [1, 2]
    for k, url, _ in pages:
        host = url.split("/")[2]
        known = 1 if "casino" in host else bad.get(k)
        if known is not None:
            for key in (host, host.split(".", 1)[1], "org"):
                count[key][0] += known
                count[key][1] += 1
            rate = [rate[0] + known, rate[1] + 1]

    def strength(children):
        x = sum(n * (b / n - m) ** 2 / (m * (1 - m)) - 1 for b, n, m in children)
        return 1 / min(max(x / sum(n - 1 for _, n, _ in children), 0.001), 0.5) - 1

    m = rate[0] / rate[1]
    domains = {d: count[d] for d in {h.split(".", 1)[1] for h in hosts}}
    k = strength([(*count["org"], m)])
    above = {d: (count["org"][0] - b + k * m) / (count["org"][1] - n + k) for d, (b, n) in domains.items()}
    k = strength([(b, n, above[d]) for d, (b, n) in domains.items()])
    own = lambda h: h.split(".", 1)[1]
    prior = {h: (domains[own(h)][0] - count[h][0] + k * above[own(h)]) / (domains[own(h)][1] - count[h][1] + k) for h in hosts}
    k = strength([(*count[h], prior[h]) for h in hosts])
    for r in out:
        b, n = count[r.host]
        alpha, beta = b + k * prior[r.host], n - b + k * (1 - prior[r.host])
        t = alpha + beta
        assert r.bad_bound == pytest.approx(alpha / t - 1.645 * math.sqrt(alpha * beta / (t * t * (t + 1))), abs=1e-5)


def test_other_tokenizers(spark, texts):
    """A vocabulary that keeps case and white space is asked for whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    some = [(k, x, "", "") for k, x in enumerate(["A a  A!", "Word word\n WORD", *texts[:20]])] + [(5, "Word word", "", "")] * 2
    assert packing.chunks(TOKENIZER).chunked and not packing.chunks(path).chunked
    by_doc = defaultdict(list)
    for r in packing.pack_documents(frame(spark, some), path).collect():
        by_doc[r.doc_id].append(r)
    want = defaultdict(list)
    for k, x, *_ in some:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want[k].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for k, own in want.items():
        assert sorted((r.length, r.ids_crc32) for r in by_doc[k] if r.length == r.doc_tokens) == sorted(x for x in own if any(r.length == r.doc_tokens for r in by_doc[k])) or len(by_doc[k]) > len(own)
        assert sum(r.length for r in by_doc[k]) == sum(n for n, _ in own)


def test_vectors_of_several_lengths(spark):
    rnd = np.random.default_rng(34)
    rows = [(k, rnd.standard_normal(8 if k % 3 else 5).tolist()) for k in range(900)]
    out = ann.search(ann.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), spark.createDataFrame(rows[::100], "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 900, 100):
        d = sorted((math.dist(x, rows[q][1]), k) for k, x in rows if k != q and len(x) == len(rows[q][1]))
        hits += len(set(got[q]) & {k for _, k in d[:10]})
    assert set(got) == set(range(0, 900, 100)) and hits >= 88


def test_tiles_find_the_same(monkeypatch):
    import pandas as pd

    rnd = np.random.default_rng(35)
    x = rnd.standard_normal((500, 12))
    x[50:60] = x[50]
    centre, turn = x.mean(0), ann.rotation(12)
    codes, norm, own = ann.encode(x, centre, turn)
    part = pd.DataFrame({"vec_id": np.arange(500), "embedding": list(x), "code": [c.tobytes() for c in codes], "norm": norm, "own": own})
    asked = part.iloc[::25][["vec_id", "embedding"]]
    whole = ann.nearest(part, asked, 10, centre, turn, 100.0)
    monkeypatch.setattr(ann, "TILE_ROWS", 37)
    monkeypatch.setattr(ann, "TILE_QUERIES", 3)
    assert ann.nearest(part, asked, 10, centre, turn, 100.0).reset_index(drop=True).equals(whole.reset_index(drop=True))
    for q, own_rows in whole.groupby("query_id"):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert own_rows.vec_id.tolist() == np.lexsort((np.arange(500), d))[:10].tolist()


def test_near_duplicates_of_one_id_with_two_texts(spark):
    rnd = random.Random(36)
    a, b = invented(rnd, 80), invented(rnd, 80)
    rows = [(1, a, "", ""), (1, b, "", ""), (2, a + " more", "", ""), (3, b + " more", "", ""), (4, invented(rnd, 80), "", "")]
    got = {(r.doc_id, r.component_id) for r in near_dedup.link_documents(frame(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def edited(rnd, words):
    """A copy of ``words`` with up to a fifth of them changed, as a text."""
    share = rnd.random() / 5
    return " ".join(f"x{rnd.getrandbits(40)}" if rnd.random() < share else w for w in words)


def test_near_copies_meet_minima_and_texts_once(spark, monkeypatch):
    """Joins by vertex make at most a row a vertex, however many nodes and pivots it is at."""
    from pyspark.sql.classic.dataframe import DataFrame

    rnd = random.Random(41)
    words = invented(rnd, 150).split()
    every = {k: edited(rnd, words) for k in range(120)}
    made, join = [], DataFrame.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if how is None and on in ("v", ["v", "b0", "b1"]):
            made.append(out.count())
        return out

    monkeypatch.setattr(DataFrame, "join", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link_documents(frame(spark, every.items(), "doc_id long, text string", False), leaf=24).collect()}
    assert got == components(every) and len({c for _, c in got.values()}) < len(every)
    assert len(made) > 3 and 50 < max(made) <= len(every)


def test_versions_of_one_id_do_not_multiply(spark, monkeypatch):
    """Several texts of one id stand in a node once each."""
    rnd = random.Random(42)
    words = invented(rnd, 150).split()
    rows = [(k % 20, edited(rnd, words)) for k in range(60)]
    made, cut = [], near_dedup.Scratch.cut

    def counted(self, df):
        out = cut(self, df)
        if out.columns == ["node", "used", "v", "n", "b0", "b1"]:
            made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(near_dedup.Scratch, "cut", counted)
    got = {(r.doc_id, r.component_id) for r in near_dedup.link_documents(frame(spark, rows, "doc_id long, text string", False), leaf=24, depth=3).collect()}
    names = {k: k for k in range(20)}
    for k, (_, root) in components({k: t for k, (_, t) in enumerate(rows)}).items():
        x, y = sorted((names[k % 20], names[root % 20]))
        names = {d: x if c == y else c for d, c in names.items()}
    assert got == set(names.items()) and 1 < len(set(names.values())) < 20
    assert made and all(a == b for a, b in made)


def test_templates_fall_apart(spark):
    """Pages that share most of a template, but not enough to be linked, end in small nodes, and none is linked."""
    rnd = random.Random(37)
    frame_words = invented(rnd, 90)
    rows = [(k, frame_words + " " + invented(rnd, 35), "", "") for k in range(200)] + [(200 + k, frame_words + " " + invented(random.Random(5), 35 - k), "", "") for k in range(3)]
    got = {r.doc_id: r.component_id for r in near_dedup.link_documents(frame(spark, rows)).collect()}
    assert got == {k: min(k, 200) for k in range(203)}


def test_pipeline_of_nothing_and_of_odd_columns(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, n_deleted int, gone int, row int, copies int, mark int"
    none = spark.createDataFrame([], schema)
    none.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    rnd = random.Random(38)
    passage = [spoken(rnd, "aa", 30), spoken(rnd, "aa", 30)]
    rows = [(k, "\n".join([spoken(rnd, "aa", 12), *(passage if k % 2 else []), spoken(rnd, "aa", 9)]), "aa", "s", 1, 5, 6, 7, 8, 9) for k in range(30)]
    current = spark.createDataFrame(rows + [(None, None, None, None, None, None, None, None, None, None)] + rows[:1], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, "")
        assert out.columns == current.columns
        path = str(tmp_path / stage.__name__)
        out.write.parquet(path)
        current = spark.read.parquet(path)
    assert {(r.n_deleted, r.gone, r.row, r.copies, r.mark) for r in current.collect()} == {(5, 6, 7, 8, 9)}
    assert all(r.n_chars == len(r.text) for r in current.collect())


def test_scratch_folders(spark):
    from eventlens.llm._shared import Scratch, shared_folder

    scratch = Scratch(spark, "test")
    kept = scratch.cut(spark.range(5))
    other = scratch.cut(spark.range(7))
    scratch.drop(other)
    assert kept.count() == 5 and scratch.folder.startswith(shared_folder(spark))
    files = spark._jvm.org.apache.hadoop.fs.Path(scratch.folder)
    assert [x.getPath().getName() for x in files.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(files)] == ["1"]


def test_shared_folder_is_asked_for_on_clusters():
    from eventlens.llm._shared import shared_folder

    class Conf(dict):
        get = dict.get

    session = lambda **conf: type("Session", (), {"conf": Conf({k.replace("_", "."): v for k, v in conf.items()})})()
    with pytest.raises(ValueError):
        shared_folder(session(spark_master="yarn"))
    assert shared_folder(session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(session(spark_master="local[2]")).endswith("checkpoints")
