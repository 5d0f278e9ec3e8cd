import random
import time

import numpy as np
import pytest
import xxhash

from trawl.llm import minhash, substring_dedup
from trawl.llm.word_hashes import word_hashes


def test_each_word_has_its_xxh64():
    rng = random.Random(3)
    for k in range(300):
        data = bytes(rng.choice(b"abc \n\t\r\x0b\x0c\x00\x1c\x85\xa0\xc3\xa9") if rng.random() < 0.9 else rng.randrange(256) for _ in range(k))
        data += b" ".join(bytes([97 + k % 26]) * n for n in rng.sample(range(90), k % 9))
        w, starts = word_hashes(data)
        assert w.tolist() == [xxhash.xxh64_intdigest(x) for x in data.split()]
        assert all(data[i:].split(None, 1)[0] == x and (not i or data[i - 1 : i].isspace()) for i, x in zip(starts.tolist(), data.split()))


def test_shingles_of_pieces_are_those_of_their_texts(prose):
    rng = random.Random(4)
    texts = [t.encode() for t in ("", " \n", "A", "a b c d", "B É a b c", prose(5, 70), "ab " * 50 + "x" * 70, prose(6, 9).upper())] * 3
    rng.shuffle(texts)
    h, sizes = minhash.shingles(texts)
    parts = np.split(h, np.cumsum(sizes)[:-1])
    for text, own in zip(texts, parts):
        w = text.lower().split()
        n = len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else min(len(w), 1)
        alone, _ = minhash.shingles([text])
        assert len(own) == n and own.tolist() == alone.tolist() == sorted(set(own.tolist()))


def test_shingles_cost_less_than_one_split_and_one_hash_of_each_word():
    """Texts of many different words, which no cache of words helps; before, they cost over twice that."""
    rng = random.Random(5)
    texts = [" ".join("%x" % rng.randrange(16 ** rng.randrange(2, 9)) for _ in range(400)).encode() for _ in range(600)]

    def least(run):
        took = []
        for _ in range(3):
            start = time.process_time()
            run()
            took.append(time.process_time() - start)
        return min(took)

    plain = least(lambda: [np.fromiter(map(xxhash.xxh64_intdigest, t.lower().split()), np.uint64) for t in texts])
    assert least(lambda: minhash.shingles(texts)) < 1.3 * plain


@pytest.mark.parametrize("chunk", [1, 400, substring_dedup.CHUNK_BYTES])
def test_paragraphs_signed_in_one_pass(table, odd, prose, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    lines = [prose(40 + k, 3 + 5 * k % 37) for k in range(60)]
    rows = list(odd) + [(50 + k, "\n".join(lines[k : k + 9]) + "\n" * (k % 4) + "É \x0b " + lines[-k]) for k in range(40)]
    docs, how = table(rows), substring_dedup.PARAGRAPHS
    for n in (3, 30):
        made = substring_dedup.paragraph_signatures(docs, n, how)
        want = minhash.signatures(substring_dedup.paragraphs(docs, n), how.bands, how.rows, how.words)
        assert made.columns == want.columns
        got, want = ([tuple(r) for r in x.collect()] for x in (made, want))
        assert len(got) > 40 and got == want


def test_a_run_ends_where_its_last_window_ends(table, prose):
    """Runs of several windows, two in a document, with other words between them."""
    first, second = prose(70, 200), prose(71, 90)
    rows = [(1, first + "\n" + prose(72, 80) + "\n" + second), (2, prose(73, 40) + " " + first + "\n" + prose(74, 100) + "\n" + second + " " + prose(75, 31))]
    found = sorted((r.first_word, r.n_words, r.paragraph, r.last_paragraph, r.keep_first_word) for r in substring_dedup.repeated_runs(table(rows)).filter("removed").collect())
    assert [(a - c, p, q) for a, _, p, q, c in found] == [(40, 0, 0), (60, 2, 2)]
    for (start, n, *_), (low, high) in zip(found, [(40, 240), (340, 430)]):
        assert low <= start <= low + 20 and high - 20 <= start + n <= high
