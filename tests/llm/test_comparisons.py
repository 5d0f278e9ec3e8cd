import collections
import re
import zlib

import numpy as np
import pytest

from trawl.llm import divergence, hard_negatives, language_id

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NAMES = "doc_id long, text string, lang string, source string, n long, term string, docs long, total long, id long, whole string, tile int, value string, rank int"


@pytest.fixture
def sourced(spark):
    """Documents with columns whose names the operator uses inside."""
    return lambda rows: spark.createDataFrame([(k, *r, 1, "t", 1, 1, 1, "w", 1, "v", 1) for k, r in enumerate(rows)], NAMES)


# Divergence


def test_gallop():
    rng = np.random.default_rng(5)
    for n, m in [(0, 5), (5, 0), (3, 900), (900, 3), (400, 5000), (5000, 400), (64, 64)]:
        keys, run = (np.unique(rng.integers(0, 3000, k)) for k in (n, m))
        assert (divergence.gallop(keys, run) == np.searchsorted(run, keys)).all()


@pytest.mark.parametrize("whole", [7, 10**9, 9 * 10**15])
def test_shares_are_exact(whole):
    counts = np.unique(np.concatenate([[0, 1, 2], np.random.default_rng(1).integers(0, whole - 4, 50)]))
    assert divergence.shares(counts, whole).tolist() == [1 + 10**9 * (c + 5) // whole for c in counts.tolist()]


def expected_divergence(rows, least, top):
    groups, docs, sums = {}, collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        lang, words = lang or "", TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups.setdefault((lang, source or ""), collections.Counter()).update(words)
        docs[lang].update(set(words))
        sums[lang].update(words)
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = shares(own), shares(sums[lang])
        pairs = [(s, sum(abs(p[t] - v) for t, v in shares(c).items())) for (g, s), c in groups.items() if g == lang and s != source]
        terms = [(t, p[t] - q[t]) for t in kept if own[t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, k) for k, (item, v) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "block", "tile"), [(30, 50, 32_768, 8), (2, 5, 3, 1), (1, 50, 7, 2)])
def test_divergence_against_brute_force(sourced, least, top, block, tile):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abé")) for _ in range(1 + rng.integers(3)))
    rows = [(" ".join(word() for _ in range(rng.integers(1, 30))).capitalize(), f"l{k % 3}", f"s{rng.integers(5)}") for k in range(150)]
    rows += [(None, None, None), ("", "l0", "empty"), ("12 3!", "l0", ""), ("only here", "alone", "one"), ("a b", "l0", None), ("A-b_C\na", None, "s1")] + [("Tie tie tie", "l1", "s1")] * 40 + [("x " * 50_000, "l1", "long")]
    got = divergence.divergence(sourced(rows), least, top, block, tile)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == expected_divergence(rows, least, top)


def test_divergence_of_nothing(sourced):
    assert divergence.divergence(sourced([])).count() == 0
    assert [tuple(r) for r in divergence.divergence(sourced([(None, None, "a"), ("", None, "b")])).orderBy("source").collect()] == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


# Languages


def spoken(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.integers(1, 4))) for _ in range(n)).capitalize() + "."


TONGUES = {"aa": ["the", "ing", "on", "er", "th", "wh"], "bb": ["ção", "de", "os", "ñe", "ir"], "": ["сти", "ро", "на", "то"], "dd": ["中", "文", "字"]}


@pytest.fixture(scope="module")
def tongues():
    rng = np.random.default_rng(3)
    langs = list(TONGUES)
    return [(k, spoken(rng, TONGUES[langs[k % 4]], int(rng.integers(3, 60))), langs[k % 4]) for k in range(300)]


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 4 == 2


def test_languages(spark, tongues):
    odd = [(None, "the thing", "aa"), (900, None, "aa"), (901, "", "aa"), (902, "12 !? ½ _", "aa"), (903, "on ing the", None), (904, "qqqq zzzz xxxx jjjj", None), (904, "qqqq zzzz xxxx jjjj", None), (905, " ".join(["there wherever"] * 60_000), "aa")]
    docs = spark.createDataFrame([(*r, 1.0, False, "und", 1, "c") for r in tongues + odd], "doc_id long, text string, lang string, score double, rejected boolean, lang_pred string, part int, centroid string")
    model = language_id.fit(docs)
    assert sorted(set(model.names)) == sorted(TONGUES) and len(model.names) <= 4 * language_id.CENTROIDS
    rows = language_id.languages(docs, model, reject=False).collect()
    assert len(rows) == len(tongues) + len(odd)
    got = {r.doc_id: r for r in rows}
    own = [(got[k], lang) for k, _, lang in tongues if held(k)]
    assert len(own) > 50 and all(r.lang_pred == lang and 0 < r.score <= 1 for r, lang in own)
    assert sum(r.rejected for r, _ in own) <= 0.05 * len(own)
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (900, 901, 902))
    assert got[None].lang_pred == got[903].lang_pred == got[905].lang_pred == "aa" and got[904].rejected
    assert {r.doc_id for r in language_id.languages(docs, model).collect() if r.lang_pred == "und"} >= {900, 904}


def test_held_out_rows_are_not_learned_from(spark, tongues):
    docs = spark.createDataFrame([(k, t, "wrong" if held(k) else lang) for k, t, lang in tongues], "doc_id long, text string, lang string")
    assert "wrong" not in language_id.fit(docs).names
    assert all(r.learned != held(r.doc_id) for r in docs.select("doc_id", language_id.learned(docs.doc_id).alias("learned")).collect())


def test_languages_without_a_sample(spark, tongues):
    docs = spark.createDataFrame(tongues, "doc_id long, text string, lang string")
    model = language_id.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language_id.languages(docs, model).collect()} == {("und", 0.0)}
    assert language_id.languages(docs.limit(0), model).count() == 0


def test_sample_is_bounded(spark):
    rows = [(k, f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} and more" if k % 3 else "one copied text", "aa" if k % 7 else "bb") for k in range(4000)]
    sample = language_id.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100, 1).collect()
    assert {r.lang for r in sample} == {"aa"} and 50 < len(sample) < 160 and len({r.text for r in sample}) == len(sample)


def test_grams_do_not_depend_on_slices(monkeypatch):
    text = "The quick brown fox, éàü! " * 40
    whole = language_id.counted([text])
    monkeypatch.setattr(language_id, "SLICE", 50)
    assert (language_id.counted([text]) == whole).all() and whole.any()
    words = ["the", "quick", "brown", "fox", "éàü"] * 40
    own = [w for word in words for w in [*word, *map("".join, zip(f" {word} ", f" {word} "[1:])), *map("".join, zip(f" {word} ", f" {word} "[1:], f" {word} "[2:]))]]
    assert (whole**2).sum() == pytest.approx(len(own), rel=1e-6)


# Hard negatives


def expected_negatives(rows):
    own = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            own.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    last = lambda i: hard_negatives.NO_ID if i is None else i
    out = []
    for a, (i, v, label) in enumerate(own):
        if i is None or i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), last(j), k, j, other) for k, (j, w, other) in enumerate(own) if k != a]
        for p in sorted(x for x in scored if x[4] == label)[:5]:
            fits = sorted(x for x in scored if x[4] != label and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0])[:5]
            out += [(i, p[3], k, x[3], -p[0], -x[0]) for k, x in enumerate(fits, 1)]
    return sorted(out, key=str)


COLUMNS = "vec_id long, embedding array<float>, label int, uid string, score string, x int, norm string, cell string, rank int, w int, tops int"


@pytest.mark.parametrize(("tile", "block"), [(16_384, 2048), (50, 7)])
def test_negatives_against_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 6))
    rows = [(k * 5, (centres[k % 4] + rng.normal(size=6) * (0.05 + k % 3 / 4)).tolist(), int(rng.integers(4))) for k in range(400)]
    rows += [(100, rows[0][1], 1), (100, rows[0][1], 1), (None, rows[3][1], 2), (2000, None, 1), (2100, [1.0] * 6, None), (2200, [1.0, None] * 3, 1), (2300, [1.0, float("nan")] * 3, 1), (2400, [float("inf")] * 6, 1), (2500, [], 2), (2600, [0.0] * 6, 2), (2700, [0.5, 0.5], 3), (-100, [1e3] * 6, 0), (2801, [2e3] * 6, 0)]
    rows += [(3000 + k, rows[8][1], k % 5) for k in range(120)]
    table = spark.createDataFrame([(*r, "u", "s", 1, "n", "c", 1, 1, 1) for r in rows], COLUMNS)
    got = hard_negatives.hard_negatives(table, tile_rows=tile, tile_anchors=tile)
    assert got.dtypes == [(c, "int" if c == "rank" else "bigint") for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]
    want = expected_negatives(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 200


def test_negatives_of_large_numbers(spark):
    rows = [(k * 50, [3e5 + k, 2e5 - 3 * k, 1e6], k % 3) for k in range(12)]
    table = spark.createDataFrame([(*r, "u", "s", 1, "n", "c", 1, 1, 1) for r in rows], COLUMNS)
    assert max(abs(s) for *_, s in expected_negatives(rows)) > hard_negatives.EXACT
    assert sorted(map(tuple, hard_negatives.hard_negatives(table).collect()), key=str) == expected_negatives(rows)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert hard_negatives.hard_negatives(none).count() == 0
    one = spark.createDataFrame([(100, [1.0], 1, "u", "s", 1, "n", "c", 1, 1, 1)], COLUMNS)
    assert hard_negatives.hard_negatives(one).count() == 0


def test_bounds_hold_every_score():
    rng = np.random.default_rng(6)
    x = np.floor(256 * np.concatenate([rng.normal(size=(80, 9)), np.zeros((1, 9)), np.repeat(rng.normal(size=(1, 9)), 6, axis=0), rng.normal(size=(5, 9)) * 1e6]))
    norm, n = np.linalg.norm(x, axis=1), len(x)
    own = hard_negatives.Vectors(np.arange(n), np.arange(n), np.zeros(n), x, norm, hard_negatives.angles(x, norm, hard_negatives.directions_of(x, 8)))
    low, high = hard_negatives.bounds(own, own)
    score = x @ x.T
    assert (low <= score).all() and (score <= high).all()
    least, most = hard_negatives.block_bounds(own[:20], own[20:40])
    assert least <= score[:20, 20:40].min() and score[:20, 20:40].max() <= most
    near = x[:1] + np.arange(9) // 8
    assert (high[:80, :80] < norm[:80, None] * norm[None, :80]).mean() > 0.5 and near.any()
