import itertools
import random

import numpy as np
import pytest

from trawl.llm import components as graph
from trawl.llm import minhash, substring_dedup
from trawl.llm.components import connected_components


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def components(sets, least=75):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    return [find(k) for k in range(len(sets))]


def changed(text, rng, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(odd, prose):
    rng = random.Random(11)
    rows, base = list(odd), prose(77, 200)
    rows += [(1000 + k, changed(base, rng, rng.randrange(8))) for k in range(60)]  # a large group, beyond a bucket's neighbours
    for k in range(40):
        own = prose(2000 + k, rng.randrange(3, 150))
        rows += [(2000 + 10 * k + j, changed(own, rng, rng.randrange(5))) for j in range(3)]
    shared = prose(88, 100)
    rows += [(4000 + k, shared + " " + prose(5000 + k, 80)) for k in range(30)]  # half of each is the same
    return rows


@pytest.mark.parametrize("block, broadcast", [(minhash.BLOCK, minhash.BROADCAST_IDS), (8, minhash.BROADCAST_IDS), (8, 0)])
def test_near_duplicates_against_brute_force(table, corpus, monkeypatch, block, broadcast):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", broadcast)
    sets = [shingle_set(t) for _, t in corpus]
    found = components(sets)
    lowest = {}
    for (i, _), c in zip(corpus, found):
        if i is not None:
            lowest[c] = min(lowest.get(c, i), i)
    want = sorted((str(i), len(s), str(lowest.get(c) if s else i)) for (i, _), s, c in zip(corpus, sets, found))
    got = minhash.near_duplicates(table(corpus)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_of_each_component_stays(table, corpus):
    docs = table(corpus)
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in minhash.near_duplicates(docs).collect() if r.kept}
    assert {r.doc_id for r in out.collect()} == kept
    assert minhash.near_duplicates(table([])).count() == 0 and minhash.near_duplicates(table([(1, ""), (2, None)])).filter("kept").count() == 2


def test_sketches_are_concentrated():
    rng = np.random.default_rng(5)
    t, off = 200, []
    for k in range(60):
        both = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.sort(both[:300]), np.sort(both[k:])
        s = minhash.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]), t)
        off.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 0.16
    for n in (1, 2, 7):
        s = minhash.sketches(rng.integers(0, 2**63, n, dtype=np.uint64), np.array([n]), t)
        assert (s != np.uint64(2**64 - 1)).all()


@pytest.mark.parametrize("local", [graph.LOCAL, 40])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(200)] + [(500 + rng.randrange(40), 500 + rng.randrange(40)) for _ in range(25)] + [(900, k) for k in range(901, 990)] + [(7, 7), (3, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_paragraphs(table, odd, prose):
    rng = random.Random(9)
    passage = prose(700, 60)
    rows = list(odd) + [(100 + k, prose(800 + k, 40) + "\n" + (changed(passage, rng, 1) if k else passage) + "\nshort line") for k in range(25)]
    rows += [(200, prose(900, 50)), (201, passage + "\n" + passage), (202, passage[: len(passage) // 3])]
    paragraphs = [(i, p, line) for i, t in rows for p, line in enumerate((t or "").split("\n")) if len(line.encode().split()) >= substring_dedup.MIN_WORDS]
    sets = [shingle_set(line) for *_, line in paragraphs]
    found = components(sets)
    groups = {}
    for (i, p, _), c in zip(paragraphs, found):
        groups.setdefault(c, []).append((i is None, i or 0, p, i))
    want = sorted((str(own[3]), own[2], str(min(g)[3]), min(g)[2]) for g in groups.values() if len(g) > 1 for own in g)
    got = substring_dedup.repeats(table(rows)).collect()
    assert sorted((str(r.doc_id), r.paragraph, str(r.keep_id), r.keep_paragraph) for r in got) == want
    assert all(r.removed == ((r.doc_id, r.paragraph) != (r.keep_id, r.keep_paragraph)) for r in got)
    cut = {r.doc_id: r.text for r in substring_dedup.remove_repeats(table(rows)).collect() if r.doc_id}
    assert cut[100] == prose(800, 40) + "\n" + passage + "\nshort line" and cut[101] == prose(801, 40) + "\nshort line" and cut[201] == "" and cut[200] == prose(900, 50)
    assert substring_dedup.repeats(table([])).count() == 0
    names = table(rows).withColumnsRenamed({"lang": "__id", "source": "__gone", "key": "doc"})
    assert substring_dedup.remove_repeats(names).columns == names.columns


def test_recall_near_the_threshold(table):
    """Of pairs of similarity 0.75 to 0.8, hidden among texts that share much with them, hardly one is missed."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**7)}"
    rows, pairs = [], []
    for k in range(1200):
        text = [word() for _ in range(rng.randrange(60, 240))]
        other = list(text)
        # A changed word takes five shingles of n: similarity (n - 5 c) / (n + 5 c).
        n = len(text) - 4
        for c in rng.sample(range(4, len(text) - 4, 5), max(1, round(n / 5 * (0.125 + 0.0173 * rng.random())))):
            other[c] = word()
        a, b = shingle_set(" ".join(text)), shingle_set(" ".join(other))
        if 75 * len(a | b) <= 100 * len(a & b) <= 80 * len(a | b):
            pairs.append((3 * k, 3 * k + 1))
        rows += [(3 * k, " ".join(text)), (3 * k + 1, " ".join(other)), (3 * k + 2, " ".join(text[: len(text) // 2] + [word() for _ in range(40)]))]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(rows)).collect()}
    caught = sum(found[a] == found[b] for a, b in pairs)
    assert len(pairs) > 500 and caught >= 0.995 * len(pairs)
