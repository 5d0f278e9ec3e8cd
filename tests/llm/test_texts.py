import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from trawl.llm import decontam, elias_fano, license_scan, lm_score, quality, sp_sampling, token_counts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# Quality


def test_quality(spark, table, odd, prose):
    rng = np.random.default_rng(0)
    rows = [(k, prose(k, 60).capitalize() + "." if k % 2 else " | ".join(prose(k, int(rng.integers(20, 60))).split())) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(400)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(table(rows), labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())
    held = [r for r in got.values() if r.held_out]
    assert len(held) > 80 and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.97 * len(held)
    assert quality.quality_scores(table(odd), labels).count() == len(odd)
    assert {r.score for r in quality.quality_scores(table(odd), labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(table([]), labels).count() == 0
    out = quality.drop_low_quality(table(rows), labels)
    assert out.columns == table(rows).columns and {r.doc_id % 2 for r in out.collect()} == {1}


def test_densities_match_numpy():
    rng = np.random.default_rng(1)
    covariance = np.cov(rng.normal(size=(50, 3)).T)
    factor = np.linalg.cholesky(covariance)
    model = quality.Discriminant(np.zeros((2, 3)) + [[0], [1]], np.array([factor] * 2), np.full(2, 2 * np.log(np.diag(factor)).sum()), np.log([0.5, 0.5]))
    x = rng.normal(size=(5, 3))
    d = lambda m: -0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(covariance), x - m)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(d(0) - d(1))))


def test_fit_against_numpy(spark, table, prose):
    rows = [(k, prose(k, 20 + k % 50).capitalize() + "." if k % 2 else " | ".join(prose(k, 10 + k % 30).split())) for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(120)] + [(4, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(quality.text_statistics(table(rows)), labels)
    x = np.array([quality.statistics(t) for _, t in rows])
    own = [np.array([v for k, v in enumerate(x) if k % 2 == label and k != 4]) for label in (0, 1)]
    cov = [np.cov(v.T, bias=True) for v in own]
    pooled = sum(c * len(v) for c, v in zip(cov, own)) / sum(map(len, own))
    for label in (0, 1):
        shrunk = (1 - quality.TO_POOLED) * cov[label] + quality.TO_POOLED * pooled
        shrunk = (1 - quality.TO_IDENTITY) * shrunk + quality.TO_IDENTITY * np.trace(shrunk) / len(shrunk) * np.eye(len(shrunk))
        assert np.allclose(model.means[label], own[label].mean(axis=0)) and np.allclose(model.factors[label] @ model.factors[label].T, shrunk, atol=1e-8)
        assert model.log_dets[label] == pytest.approx(np.linalg.slogdet(shrunk)[1]) and model.log_priors[label] == pytest.approx(math.log(len(own[label]) / 119))


def test_statistics_of_small_texts():
    root = math.sqrt
    got = quality.statistics("Ab ab! 12 |\nlong-word.")
    w = ["Ab", "ab!", "12", "|", "long-word."]
    want = [math.log1p(5), math.log1p(sum(map(len, w)) / 5), math.log1p(10), root(1 / 12), root(2 / 22), root(2 / 22), 1.0, 0.0, root(1 / 5), root(1 / 5), root(4 / 5), math.log1p(5 / 3), math.log1p(5 / 2)]
    assert got == pytest.approx(want)
    assert quality.statistics("") == [0.0] * 13 and quality.statistics("a a a")[6:8] == pytest.approx([root(1 / 3), root(2 / 3)])


# Licenses


def test_licenses_against_brute_force(table, odd, prose):
    texts = ["GNU General Public License, gnu general public-license", "MIT license MIT License", "x cc by", "the apache", "apache licenses", prose(4, 30) + " Apache License " + prose(5, 30), license_scan.NOTICES[5][1].upper()]
    rows = odd + [(100 + k, t) for k, t in enumerate(texts)]
    got = sorted(map(tuple, license_scan.license_labels(table(rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=str)
    want = []
    for i, t in rows:
        w = words(t)
        at = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        want.append((i, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=str)


def test_notices_survive_small_changes(table, prose):
    notice = license_scan.NOTICES[6][1].split()
    changed = notice[:6] + ["really"] + notice[6:15] + notice[16:]
    rows = {r.doc_id: r for r in license_scan.license_labels(table([(1, prose(1, 50) + " " + " ".join(changed)), (2, " ".join(notice[:6])), (3, "permission is " * 30)])).collect()}
    assert rows[1].labels == "mit" and 0.6 <= rows[1].score < 1 and rows[2].labels == "" and rows[3].score == 0
    plan = license_scan.license_labels(table([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert license_scan.license_labels(table([])).count() == 0


def notice_share(w, notice):
    """The most of a notice's trigrams that stand on diagonals near each other, by trying every diagonal."""
    t = notice.split()
    at = {}
    for p in range(len(w) - 2):
        for k in range(len(t) - 2):
            if w[p : p + 3] == t[k : k + 3]:
                at.setdefault(p - k, set()).add(k)
    near = lambda d: set().union(*(v for e, v in at.items() if abs(e - d) <= license_scan.NEAR))
    return max((len(near(d)) / (len(t) - 2) for d in at), default=0.0)


def test_notice_labels_against_brute_force(table, prose):
    notice = license_scan.NOTICES[1][1]
    texts = ["under cc by under cc by under cc by", notice, "you may not " * 8 + notice, "of the " * 400 + notice[:60], license_scan.NOTICES[16][1] + " " + license_scan.NOTICES[13][1]]
    texts += [prose(k, 20) + " " + " ".join(w for j, w in enumerate(license_scan.NOTICES[13 + k][1].split()) if (j + k) % 9) for k in range(9)]
    for r in license_scan.license_labels(table([*enumerate(texts)])).collect():
        w = words(texts[r.doc_id])
        shares = {(label, t): notice_share(w, t) for label, t in license_scan.NOTICES}
        want = {label for (label, _), v in shares.items() if v >= license_scan.LEAST_SHARE} | ({*r.base_labels.split(",")} - {""})
        assert r.labels == ",".join(sorted(want)), r.doc_id
        assert r.base_labels or r.score == pytest.approx(max((v for v in shares.values() if v >= license_scan.LEAST_SHARE), default=0.0))
    assert license_scan.license_labels(table([(1, texts[0])])).first().labels == "cc-by" and license_scan.license_labels(table([(1, texts[2])])).first().score == 1


@pytest.mark.parametrize("most", [license_scan.MOST_GRAMS, 40])
def test_own_templates(spark, table, odd, prose, monkeypatch, most):
    monkeypatch.setattr(license_scan, "MOST_GRAMS", most)
    texts = {"a-1.0": prose(501, 60), "b-2": "Permission is hereby granted, FREE of charge: " + prose(502, 30), "c": prose(503, 45) + " " + prose(501, 20)}
    rows = [(label, text, 1) for label, text in texts.items()] + [("short", "two words", 2), ("none", None, 3), (None, prose(504, 9), 4), ("a-1.0", texts["a-1.0"], 5)]
    own = spark.createDataFrame(rows, "label string, text string, gram int")
    docs = odd + [(300, prose(510, 40) + " " + "".join(c.upper() if c.isascii() else c for c in texts["a-1.0"]) + " cc by"), (301, texts["b-2"] + "\n" + prose(504, 9)), (302, " ".join(texts["c"].split()[:50]) + " two words"), (303, license_scan.NOTICES[6][1])]
    every = [(label or "unknown", " ".join(words(text))) for label, text, _ in rows if text and len(words(text)) > 2]
    got = license_scan.license_labels(table(docs), own).collect()
    assert len(got) == len(docs) and {r.doc_id: r.labels for r in got if r.doc_id in (300, 301, 303)} == {300: "a-1.0,cc-by", 301: "b-2,unknown", 303: ""}
    for r in [r for r in got if r.doc_id and r.doc_id >= 300]:
        w = words(dict(docs)[r.doc_id])
        want = {label for label, text in every if notice_share(w, text) >= license_scan.LEAST_SHARE} | ({*r.base_labels.split(",")} - {""})
        assert (r.labels, r.n_words) == (",".join(sorted(want)), len(w))
    nothing = license_scan.license_labels(table(docs), own.limit(0)).filter("doc_id >= 300").collect()
    assert {r.doc_id: r.labels for r in nothing} == {300: "cc-by", 301: "", 302: "", 303: ""}


def test_documents_are_not_dealt_out_to_meet_templates(table, monkeypatch):
    monkeypatch.setattr(license_scan, "MOST_GRAMS", 200)
    plan = license_scan.votes(table([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") > 1 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "Python" not in plan


# Decontamination


def windows_of(items, size):
    """The distinct windows of items (id, text)."""
    split = [words(t) for _, t in items]
    return {tuple(b[k : k + size]) for b in split if b for k in range(max(1, len(b) - size + 1))}


def hits(text, items, size):
    w, marked, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        wins = {tuple(b[k : k + size]) for k in range(max(1, len(b) - size + 1))} if b else set()
        for win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    marked |= set(range(k, k + len(win)))
                    found.add("" if item is None else str(item))
    return len(w), len(marked), len(found)


@pytest.mark.parametrize(("size", "broadcast"), [(10, decontam.BROADCAST_ROWS), (3, decontam.BROADCAST_ROWS), (10, 0)])
def test_decontamination_against_brute_force(spark, table, odd, prose, monkeypatch, size, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast)
    item = prose(50, 30)
    items = [(1, item), (2, "ONE two"), (3, ""), (4, None), (5, " ".join(item.split()[:12])), (None, "zz"), (1, "seven of nine"), (10, "a a a a a a a a a a a")]
    w = item.split()
    rows = odd + [(100, prose(51, 20) + " " + " ".join(w[5:16]) + " end"), (101, " ".join(w[:9])), (102, item + " " + item), (103, "one, TWO; one two"), (104, "zz"), (105, "a " * 25), (106, " ".join(w[12:22][::-1])), (None, item)]
    benchmark = spark.createDataFrame([(i, t, 1, "z") for i, t in items], "item_id long, text string, wid int, words string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(table(rows), benchmark, size).collect())
    assert got == sorted((str(i), *hits(t, items, size)) for i, t in rows)
    left = decontam.decontaminate(table(rows), benchmark, size)
    assert all(hits(r.text, items, size)[1] == 0 for r in left.collect()) and left.columns == table(rows).columns


def test_decontamination_of_nothing(spark, table, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.contamination(table(odd), none).collect())
    assert decontam.contamination(table([]), none).count() == 0
    index = decontam.build_index(table([(1, "x alpha q beta gamma"), (2, "beta alpha")]), spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"), 3)
    assert decontam.phrase_matches(index).count() == 0


@pytest.mark.parametrize("broadcast", [decontam.BROADCAST_ROWS, 0])
def test_proximity_against_brute_force(spark, table, odd, prose, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast)
    rng, size, slop = random.Random(8), 6, 2
    items = [(1, prose(60, 25)), (2, "ONE two"), (3, "zz"), (4, None), (5, "a b a b a b a")]
    w = items[0][1].split()
    rows = odd + [(100, " ".join(w)), (101, "one q two"), (102, "zz x zz"), (103, "a b b a a b x a b")]
    for k in range(30):
        own = w[k % 15 : k % 15 + 9]
        for _ in range(k % 4):
            i, j = rng.randrange(len(own)), rng.randrange(len(own))
            own[i], own[j] = own[j], own[i]
        rows.append((200 + k, " ".join([*own[: k % 5], "new", *own[k % 5 :]])))
    split = [words(t) for _, t in rows]
    counts = collections.Counter(x for own in split for x in own)
    want = []
    for (i, _), own in zip(rows, split):
        for win in windows_of(items, size):
            offset = min(range(len(win)), key=lambda k: (counts[win[k]], k))
            for p in (p for p, x in enumerate(own) if x == win[offset]):
                around = lambda k: own[max(p - offset + k - slop, p - size + 1, 0) : max(0, min(p - offset + k + slop + 1, p + size))]  # noqa: B023, E731
                if all(x in around(k) for k, x in enumerate(win)):
                    want.append((str(i), " ".join(win), p))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    index = decontam.build_index(table(rows), benchmark, size)
    index.save(str(tmp_path / "index"))
    index = decontam.PositionalIndex.load(spark, str(tmp_path / "index"))
    got = decontam.proximity_matches(index, slop).join(index.windows, "wid").collect()
    assert sorted((str(r.doc_id), " ".join(r.words), r.pos) for r in got) == sorted(want) and len(want) > 30
    exact = sorted((str(r.doc_id), " ".join(r.words), r.start) for r in decontam.phrase_matches(index).join(index.windows, "wid").collect())
    assert exact == sorted((str(i), " ".join(win), k) for (i, _), own in zip(rows, split) for win in windows_of(items, size) for k in range(len(own)) if tuple(own[k : k + len(win)]) == win)


# Sampled pieces


@pytest.fixture(scope="module")
def own():
    return sp_sampling.Lattices(sp_sampling.MODEL, 1.0)


def test_marginals_against_enumeration(own):
    def paths(u):
        if not u:
            yield (), 0.0
        for k in range(1, len(u) + 1):
            if f := own.weights.get(u[:k]):
                for rest, w in paths(u[k:]):
                    yield (f[0], *rest), w + f[1]

    p = {path: math.exp(w) for path, w in paths(" then")}
    whole, n = sum(p.values()), 20_000
    got = collections.Counter(tuple(x.tolist()) for x in sp_sampling.encode_texts(["then"] * n, list(range(n)), own, 1))
    for path, v in p.items():
        assert abs(got[path] / n - v / whole) < 4 * math.sqrt(v / whole / n) + 2e-3
    assert set(got) <= set(p)


def test_lossless(spark, table, odd, own):
    texts = ["", " ", "▁", "a▁b", "\r\n\t", "🙂\0é\ufdd0", "x" * 5000, "\n" * 50, " ".join("ab" for _ in range(500))]
    for t, p in zip(texts, sp_sampling.encode_texts(texts, list(range(len(texts))), own, 5)):
        assert sp_sampling.decode_pieces(p, own) == t
    rows = sp_sampling.encode_and_decode(table(odd)).collect()
    assert len(rows) == len(odd) and all(r.lossless for r in rows)
    assert [r.n_pieces for r in rows if r.doc_id in (1, 2)] == [0, 0]
    encoded = sp_sampling.encode(table(odd))
    back = encoded.withColumn("back", sp_sampling.decoded(encoded.pieces)).collect()
    assert encoded.columns == [c for c in table(odd).columns if c != "pieces"] + ["pieces"]
    assert all(r.back == (r.text or "") for r in back)
    assert sp_sampling.encode_and_decode(table([])).count() == 0


def test_reproducible(spark, table, odd):
    once = {(r.doc_id, r.text_sha256): r.pieces_sha256 for r in sp_sampling.encode_and_decode(table(odd)).collect()}
    again = {(r.doc_id, r.text_sha256): r.pieces_sha256 for r in sp_sampling.encode_and_decode(table(odd).repartition(7)).collect()}
    assert once == again
    a, b = sp_sampling.encode_and_decode(table([(1, "the thing and the other thing"), (2, "the thing and the other thing")])).collect()
    assert a.pieces_sha256 != b.pieces_sha256


def test_long_units(own, monkeypatch):
    text = "thequickbrown🙂fox" * 3000  # a unit without spaces
    (pieces,) = sp_sampling.encode_texts([text], [1], own, 3)
    assert sp_sampling.decode_pieces(pieces, own) == text
    units = [" " + text[:900], " the", " " + text[5:700]]
    cums = []
    for far in (sp_sampling.FAR, 10**9, 0):
        monkeypatch.setattr(sp_sampling, "FAR", far)
        fresh = sp_sampling.Lattices(sp_sampling.MODEL, 1.0)
        fresh.add(units)
        cums.append(fresh.cum)
    assert np.abs(cums[0] - cums[1]).max() <= 64 and np.abs(cums[0] - cums[2]).max() <= 64


def test_many_long_units(monkeypatch):
    rng = random.Random(12)
    lines = ["".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(240)) for _ in range(400)]
    fresh = sp_sampling.Lattices(sp_sampling.MODEL, 1.0)
    whole = sp_sampling.encode_texts(["\n".join(lines), "a word", ""], [1, 2, 3], fresh, 3)
    assert sp_sampling.decode_pieces(whole[0], fresh) == "\n".join(lines)
    # Small parts and few kept nodes: the same pieces, and the lattices stay small.
    monkeypatch.setattr(sp_sampling, "CHUNK", 5000)
    monkeypatch.setattr(sp_sampling, "KEPT_NODES", 10_000)
    small = sp_sampling.Lattices(sp_sampling.MODEL, 1.0)
    parts = sp_sampling.encode_texts(["\n".join(lines), "a word", ""], [1, 2, 3], small, 3)
    assert all(len(a) == len(b) and (a == b).all() for a, b in zip(whole, parts)) and len(small.begins) < 60_000 < len(fresh.begins)


@pytest.mark.parametrize("kind", ["rare", "mixed", "letters", "uncut"])
def test_units_without_end(own, kind, monkeypatch):
    rng = random.Random(9)
    text = {"rare": "".join(chr(0x20000 + rng.randrange(9000)) for _ in range(60_000)), "mixed": "thequickbrown🙂fox" * 3000, "letters": "".join(rng.choice("abcdefghij") for _ in range(30_000)), "uncut": "a" * 20_000}[kind]
    fresh = sp_sampling.Lattices(sp_sampling.MODEL, 1.0)
    (pieces,) = sp_sampling.encode_texts([text], [1], fresh, 3)
    assert sp_sampling.decode_pieces(pieces, fresh) == text
    cut = own.cut(text)
    assert "".join(cut) == text and (kind != "uncut" or len(cut) < 20) and (kind == "uncut" or len(cut) > 20)
    ends = set(np.cumsum([len(c) for c in cut])[:-1].tolist())
    crossing = {k for k in range(1, 3000) for n in range(2, len(own.by_length) + 1) for a in range(max(0, k - n + 1), k) if text[a : a + n] in own.weights and a + n > k}
    assert not ends & crossing
    monkeypatch.setattr(sp_sampling, "CHUNK", 1000)
    assert own.cut(text) == cut


def test_one_occurrence_like_many(own, monkeypatch):
    texts = ["the thing and " * 9, "othering"]
    once = sp_sampling.encode_texts(texts, [4, 5], own, 3)
    for few in (0, 10**6):
        monkeypatch.setattr(sp_sampling, "FEW", few)
        assert all((a == b).all() for a, b in zip(once, sp_sampling.encode_texts(texts, [4, 5], own, 3)))


def test_pieces_do_not_depend_on_units_before(own):
    texts = [f"unit{k} of the thing" for k in range(50)]
    alone = sp_sampling.Lattices(sp_sampling.MODEL, 1.0)
    once = sp_sampling.encode_texts(texts, list(range(50)), alone, 3)
    thresholds = alone.cum - (alone.cum - 1) // sp_sampling.UNIT * sp_sampling.UNIT
    busy = sp_sampling.Lattices(sp_sampling.MODEL, 1.0)
    sp_sampling.encode_texts([" ".join(f"other{k}x{j}" for j in range(200)) for k in range(30)], list(range(30)), busy, 3)
    before = len(busy.cum)
    again = sp_sampling.encode_texts(texts, list(range(50)), busy, 3)
    assert all((a == b).all() for a, b in zip(once, again))
    later = busy.cum[before:] - (busy.cum[before:] - 1) // sp_sampling.UNIT * sp_sampling.UNIT
    assert set(later.tolist()) <= set(thresholds.tolist())


def test_frequent_units_are_filtered_once(monkeypatch):
    common, rng = [f"common{k}" for k in range(40)], random.Random(3)
    texts = [" ".join(rng.sample(common * 3 + [f"rare{k}x{j}" for j in range(40)], 160)) for k in range(60)]
    large = sp_sampling.Lattices(sp_sampling.MODEL, 1.0)
    whole = sp_sampling.encode_texts(texts, list(range(60)), large, 3)
    monkeypatch.setattr(sp_sampling, "KEPT_NODES", 3000)
    small, filtered, add = sp_sampling.Lattices(sp_sampling.MODEL, 1.0), collections.Counter(), sp_sampling.Lattices.add
    monkeypatch.setattr(sp_sampling.Lattices, "add", lambda self, units: (filtered.update(units), add(self, units))[1])
    for k, text in enumerate(texts):
        (pieces,) = sp_sampling.encode_texts([text], [k], small, 3)
        assert len(pieces) == len(whole[k]) and (pieces == whole[k]).all()
        assert len(small.begins) <= 3000
    assert len(large.begins) > 10_000 and all(filtered[f" {c}"] == 1 for c in common)


def test_units_by_splitting():
    rng = random.Random(4)
    texts = ["", " ", "\n", " \n ", "a\0b c", "a  b", "\n\n a\n", " \r\t\u2028 x", *("".join(rng.choice("ab \n\0\té") for _ in range(rng.randrange(12))) for _ in range(5000))]
    assert all(sp_sampling._split(t) == sp_sampling._UNIT.findall(t) for t in texts)


# Language model


@pytest.mark.parametrize(("n", "top"), [(0, 10), (1, 1), (1, 2**60), (900, 50), (2000, 2**40), (2000, 2**63)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n + 1)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    f = elias_fano.EliasFano.from_parts(elias_fano.from_buffer(np.frombuffer(elias_fano.to_bytes(elias_fano.EliasFano.of(v).parts("a")), np.uint8)), "a")
    assert (f[np.arange(n)] == v).all()
    q = np.concatenate([v, v + np.uint64(1), rng.integers(0, top + 1, 300, dtype=np.uint64)])
    at, equal = f.successor(q)
    assert (at == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all()


def test_scores_against_brute_force(table, odd, prose):
    rows = odd + [(k, prose(k % 40, 30 + k % 7)) for k in range(100, 260)]
    c, pairs = collections.Counter(), collections.Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: (t or "").encode().lower().split() + [None]
    for i, t in rows:
        if not held(i):
            c.update(split(t))
            pairs.update(itertools.pairwise([0, *split(t)]))
    n, v = sum(c.values()), len(c)

    def expected(t):
        base, full, before = 0.0, 0.0, 0
        for x in split(t):
            p = (c[x] + 1) / (n + v + 1)
            c1 = c[None] if before == 0 else c[before]
            base += math.log10(p)
            full += math.log10(lm_score.BIGRAM * pairs[before, x] / c1 + (1 - lm_score.BIGRAM) * p if c1 else p)
            before = x
        return len(split(t)), sum(c[x] > 0 for x in split(t)), base, full

    got = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score, r.held_out, r.train_tokens) for r in lm_score.train_and_score(table(rows)).collect()))
    want = sorted((str(i), *expected(t), held(i), n) for i, t in rows)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[5:] == w[5:]
        assert g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-9) and g[4] == pytest.approx(w[4], rel=1e-6, abs=1e-6)


def test_probabilities_sum_to_one(table):
    docs = table([(k, t) for k, t in enumerate(["a b a c", "b a", "c c c a b"] * 3)])
    model = lm_score.train(docs)
    after_a = [10 ** (model.scores([f"a {w}".strip()])[3][0] - model.scores(["a"])[3][0]) for w in ("a", "b", "c")]
    # Each of these ends as well; only the share of the first step is compared with what is left for the end.
    assert all(0 < p < 1 for p in after_a)


def test_scores_without_training(table):
    assert lm_score.train_and_score(table([])).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = lm_score.train_and_score(table([(held, "a b")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


# Token counts


def test_ledger(spark, table, odd, prose, tmp_path):
    docs = table(odd + [(k, prose(k, 20)) for k in range(100, 120)])
    counts = token_counts.token_counts(docs)
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    total = lambda: [(r.n_docs, r.n_tokens, r.n_chars) for r in ledger.totals().collect()]
    assert total() == []
    plus, minus = (counts.selectExpr("*", f"{s} AS sign") for s in (1, -1))
    assert ledger.commit("a", plus) and not ledger.commit("a", plus)
    texts = [t or "" for _, t in odd] + [prose(k, 20) for k in range(100, 120)]
    assert total() == [(len(texts), sum(token_counts.count_tokens(texts)), sum(map(len, texts)))]
    revised = token_counts.token_counts(table([(100, "new text")])).selectExpr("*", "1 AS sign").unionByName(minus.filter("doc_id = 100"))
    assert ledger.commit("b", revised) and ledger.commit("c", minus.limit(0))
    texts[len(odd)] = "new text"
    want = [(len(texts), sum(token_counts.count_tokens(texts)), sum(map(len, texts)))]
    assert total() == want
    (tmp_path / "ledger" / "bbroken").mkdir()  # a commit that broke off
    again = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    again.compact()
    assert total() == want and again.batches() == {"a", "b", "c"} and not again.commit("b", revised)
    assert again.commit("d", minus.filter("doc_id <> 100 OR doc_id IS NULL")) and again.commit("e", token_counts.token_counts(table([(100, "new text")])).selectExpr("*", "-1 AS sign"))
    assert total() == []


def test_compaction_keeps_every_sum(spark, tmp_path):
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    change = lambda *rows: spark.createDataFrame(rows, "sign int, source string, lang string, version string, n_tokens long, n_chars long")
    assert ledger.commit("a", change((1, "s", "en", "v", 2, 5))) and ledger.commit("b", change((-1, "s", "en", "v", 2, 3)))
    ledger.compact()
    assert ledger.commit("c", change((1, "s", "en", "v", 1, -1)))
    ledger.compact()
    (r,) = ledger.totals().collect()
    assert (r.n_docs, r.n_tokens, r.n_chars) == (1, 1, 1) and ledger.batches() == {"a", "b", "c"} and not ledger.commit("b", change())


def test_token_query_against_a_recount(spark, prose, tmp_path):
    texts = [f"{prose(k, 20)} {k * 7919} x" if k % 3 else prose(k, 20) for k in range(60)] + [None, ""]
    rows = [(k if k < 61 else None, t, "en" if k % 2 else None, f"src{k % 4}") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, k % 5 > 0) for k in range(0, 60, 2)]
    spark.createDataFrame([(k, int(q), 0) for k, q in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    poor, want = {k for k, q in labels if not q}, {}
    for i, t, lang, source in rows:
        if i not in poor or i is None:
            own, text = want.setdefault((source, lang), [0, 0, 0]), re.sub("[0-9]+", "0", t or "")
            for k, v in enumerate((1, token_counts.count_tokens([text])[0], len(text))):
                own[k] += v
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens, r.n_chars] for r in token_counts.op9_token_counts(spark, str(tmp_path)).collect()}
    assert got == want


def test_a_broken_compaction_counts_once(spark, tmp_path):
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    change = lambda *rows: spark.createDataFrame(rows, "sign int, source string, lang string, version string, n_tokens long, n_chars long")
    for k in range(4):
        assert ledger.commit(f"batch {k}", change((1, "s", "en", "v", 2, 5)))
    marks = spark.createDataFrame([(f"batch {k}",) for k in range(3)], "batch string")
    sums = spark.createDataFrame([("s", "en", "v", 3, 6, 15)], token_counts._KINDS)
    ledger._write(sums, marks, "compacted:three")  # its batches are still there as well
    total = lambda: [(r.n_docs, r.n_tokens, r.n_chars) for r in ledger.totals().collect()]
    assert total() == [(4, 8, 20)] and len(ledger._current()) == 2 and not ledger.commit("batch 1", change((1, "s", "en", "v", 9, 9)))
    ledger.compact()
    assert total() == [(4, 8, 20)] and len(ledger._current()) == 1 and ledger.batches() == {f"batch {k}" for k in range(4)}
    plan = ledger.totals()._jdf.queryExecution().analyzed().toString()
    assert "batch 1" not in plan


def test_many_windows_of_few_words_are_broadcast(spark, table, prose, monkeypatch):
    items = [(k, prose(100 + k, 400)) for k in range(75)]  # 29,325 windows, 293,250 words in them, of 3,000 different ones
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = table([(1, prose(107, 60)), (2, prose(9, 60)), (3, items[3][1])])
    index = decontam.build_index(docs, benchmark)
    assert index.each.count() > 29_000
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(docs, benchmark).collect()}
    assert got == {1: (60, 60, 1), 2: (60, 0, 0), 3: (400, 400, 1)}
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(docs, benchmark).collect()} == got
