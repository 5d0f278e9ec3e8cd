import random

import numpy as np

from trawl.llm import substring_dedup


def test_passages_across_short_lines_and_inside_long_lines(table, prose):
    passage = prose(40, 54).split()
    broken = lambda *sizes: "\n".join(" ".join(passage[sum(sizes[:k]) : sum(sizes[: k + 1])]) for k in range(len(sizes)))
    texts = [broken(18, 12, 20, 4), broken(18, 12, 20, 4), broken(7, 20, 9, 18), prose(41, 50) + " " + " ".join(passage) + " " + prose(42, 60), prose(43, 200) + "\n" + " ".join(passage[2:52]) + "\tX", " ".join(passage[:29])]
    rows = [(k, t) for k, t in enumerate(texts)] + [(50 + k, prose(60 + k, 120)) for k in range(20)]
    found = {r.doc_id: r for r in substring_dedup.repeated_runs(table(rows)).filter("removed").collect()}
    assert set(found) == {1, 2, 3, 4} and {r.keep_id for r in found.values()} == {0}
    for i, r in found.items():
        own, kept = texts[i].lower().split(), texts[0].lower().split()
        assert r.n_words >= substring_dedup.MIN_WORDS and own[r.first_word : r.first_word + r.n_words] == kept[r.keep_first_word : r.keep_first_word + r.n_words]
        before = [k for k, line in enumerate(texts[i].split("\n")) for _ in line.split()]
        assert (r.paragraph, r.last_paragraph) == (before[r.first_word], before[r.first_word + r.n_words - 1])
    lines = substring_dedup.repeats(table(rows)).collect()
    assert {(r.doc_id, r.keep_id, r.removed) for r in lines} >= {(0, 0, False), (1, 0, True)}
    assert substring_dedup.repeated_runs(table([(1, None), (None, ""), (2, "a " * 80)])).filter("n_words < 30").count() == 0


def test_changed_blocks_of_short_lines(table, prose):
    block = [" ".join(prose(300, 120).split()[k : k + 8]) for k in range(0, 120, 8)]
    other = [line if k != 7 else line.replace(line.split()[3], "changed") for k, line in enumerate(block)]
    docs = table([(1, prose(301, 40) + "\n" + "\n".join(block)), (2, "\n".join(other) + "\n" + prose(302, 35))])
    assert any(r.doc_id == 2 and r.removed and r.keep_id == 1 for r in substring_dedup.repeats(docs).collect())
    assert substring_dedup.remove_repeats(docs).filter("doc_id = 2").first().text.endswith(prose(302, 35))


def test_fifty_words_always_share_a_window():
    rng = random.Random(4)
    word = lambda: b"%d" % rng.randrange(10**9)
    for _ in range(200):
        run = [word() for _ in range(substring_dedup.RUN_WORDS)]
        chosen = [set(substring_dedup.chosen_windows([*(word() for _ in range(rng.randrange(90))), *run, *(word() for _ in range(rng.randrange(90)))], 30, 50)[1].tolist()) for _ in range(2)]
        assert chosen[0] & chosen[1]


def test_texts_taken_together_choose_what_each_chooses_alone():
    rng = np.random.default_rng(5)
    for size, run_words in ((30, 50), (5, 9), (5, 5)):
        sizes = rng.integers(0, 90, 60)
        w = rng.integers(0, 3, sizes.sum()).astype(np.uint64)
        at, h, other = substring_dedup.chosen_of(w, sizes, size, run_words)
        want = []
        for start, n in zip(np.cumsum(sizes) - sizes, sizes):
            powers = [pow(int(substring_dedup._BASE), size - 1 - k, 1 << 64) for k in range(size)]
            own = [sum(int(x) * p for x, p in zip(w[start + i : start + i + size], powers)) % (1 << 64) for i in range(max(n - size + 1, 0))]
            own = substring_dedup.mixed(np.array(own, np.uint64))
            width = min(run_words - size + 1, len(own))
            want += sorted({(int(start + i + own[i : i + width].argmin()), int(own[i : i + width].min().view(np.int64))) for i in range(len(own) - width + 1) if width})
        assert [*zip(at.tolist(), h.tolist())] == want and len(other) == len(at)
