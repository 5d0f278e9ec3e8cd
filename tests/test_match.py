import random
import re

import numpy as np
import pyarrow as pa
import pytest

from trawl.functions.dialect import compile_patterns, compile_template, ignores_case, in_order, required_literal
from trawl.operators import match, pattern_index
from trawl.plans import catalog
from trawl.spec import SpecError, spec


def numbers(df):
    return sorted(r["line_number"] for r in df.collect())


MODES = "abc123\nabc.123\nabc\nabc def\nxabc\n"


@pytest.mark.parametrize(
    ("search", "lines"),
    [
        (spec("abc.123"), [2]),
        (spec(r"abc\.123"), [2]),
        (spec("abc.123", fixed=True), [2]),
        (spec("abc", boundary="word"), [2, 3, 4]),
        (spec("abc", boundary="line"), [3]),
        (spec("abc.?123"), [1, 2]),
    ],
)
def test_modes(corpus, search, lines):
    assert numbers(match.grep(corpus(a=MODES), search)) == lines


@pytest.mark.parametrize(
    ("search", "lines"),
    [
        (spec("needle", case="smart"), [1, 2]),
        (spec("Needle", case="smart"), [1]),
        (spec("needle", invert=True), [1, 3]),
        (spec(r"needl\S", case="smart"), [1, 2]),
        (spec("NEEDLE", case="ignore"), [1, 2]),
        (spec("(?-i)needle", case="ignore"), [2]),
    ],
)
def test_case(corpus, search, lines):
    assert numbers(match.grep(corpus(a="Needle\nneedle\nhay\n"), search)) == lines


@pytest.mark.parametrize(
    ("search", "lines"),
    [(spec("alpha", "gamma"), [1, 3]), (spec("alpha", "gamma", invert=True), [2]), (spec(), []), (spec(invert=True), [1, 2, 3]), (spec(""), [1, 2, 3]), (spec("zzz", ""), [1, 2, 3])],
)
def test_many_patterns(corpus, search, lines):
    assert numbers(match.grep(corpus(a="alpha\nbeta\ngamma\n"), search)) == lines


def test_word_bounds(corpus):
    text = "Watson Watson\nWatsonian\n_Watson\n(Watson)\néWatson\nWatsoné\n"
    assert numbers(match.grep(corpus(a=text), spec("Watson", boundary="word"))) == [1, 4]


@pytest.mark.parametrize(
    ("pattern", "text", "found"),
    [
        (r"^\w+$", "é", True),
        (r"(?-u:^\w+$)", "é", False),
        (r"[[:alpha:]]", "z", True),
        (r"[[:alpha:]]", ":", False),
        (r"[[:^digit:]]", "7", False),
        (r"\p{Greek}", "λ", True),
        (r"\p{Greek}", "l", False),
        (r"\P{Greek}", "λ", False),
        (r"\p{any}", "λ", True),
        (r"\pL", "7", False),
        (r"(?P<a_b>x)(?P=a_b)", "xx", True),
        (r"(?<n>x)\k<n>y", "xxy", True),
        ("b.c", "ab\rc", True),
        ("a$", "a", True),
        ("a{,2}b", "aab", True),
        ("a{x", "a{x", True),
        (r"\x{e9}", "é", True),
        (r"\Qa.b\E.", "a.bc", True),
        (r"\Qa.b\E", "axb", False),
        (r"\bfoo\b", "x foo y", True),
        (r"\b{start}foo", "xfoo", False),
        ("[]a]", "]", True),
        ("(?i)É", "é", True),
        ("(?x) a b # c", "ab", True),
        (r"(?<=x)y(?!z)", "xyz", False),
        (r"(a)(?i:B)c", "abc", True),
        (r"[\w--[a-c]]", "b", False),
        (r"[\w--[a-c]]", "d", True),
    ],
)
def test_dialect(corpus, pattern, text, found):
    assert bool(match.grep(corpus(a=text), spec(pattern)).collect()) is found


def test_no_unicode(corpus):
    assert numbers(match.grep(corpus(a="é\ne\n"), spec(r"^\w$", unicode=False))) == [2]
    with pytest.raises(SpecError):
        compile_patterns(spec(r"\pL", unicode=False))


def test_lookaround_query_agrees_with_its_sql(spark, tmp_path):
    texts = ["ation tion the", "tion tion thex", "tion tion", "tion tion a", "tion the", "tion b", "tion ²", "tion ‿", "tion tion tion ", "tion tionx"]
    spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["grep_lookaround"](spark, str(tmp_path))
    duck = pytest.importorskip("duckdb").connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(duck.execute(catalog.oracle_sql()["grep_lookaround"]).fetchall())
    assert sorted(map(tuple, got.select("doc_id", "line_number", "line").collect())) == want
    assert [n for _, n, _ in want] == [3, 4, 6, 7, 10]


def test_crlf(corpus):
    own = corpus(a="needle\r\nneedle tail\r\n")
    assert numbers(match.grep(own, spec("needle$", crlf=True))) == [1]
    assert numbers(match.grep(own, spec("needle$"))) == []
    assert [r["line"] for r in match.grep(own, spec("tail")).collect()] == ["needle tail\r"]


def test_null_data(corpus):
    assert numbers(match.grep(corpus(a="alpha\0needle\0omega\0"), spec("needle", null_data=True))) == [2]
    assert numbers(match.grep(corpus(a="abc\0needle\nneedle2\0tail\n"), spec("^needle", null_data=True))) == [2]


def test_errors():
    for wrong in ({"case": "loud"}, {"boundary": "page"}, {"before": -1}, {"dotall": True}, {"passthru": True, "after": 1}):
        with pytest.raises(SpecError):
            spec("a", **wrong)
    for pattern in ("[a", "a\\", "(?U)a"):
        with pytest.raises(SpecError):
            compile_patterns(spec(pattern))


def test_plan_time_facts():
    assert compile_patterns(spec("plain")).literals == ("plain",)
    assert compile_patterns(spec("one|two")).literals == ("one", "two")
    assert compile_patterns(spec("one", case="ignore")).literals is None
    assert required_literal("[ab]xyz+") is None and required_literal("a|xyz") is None
    assert required_literal("foo.*barbaz") == "barbaz" and required_literal("foobar?") == "fooba"
    assert ignores_case(spec(r"\S\p{Lu}x", case="smart")) and not ignores_case(spec("aB", case="smart"))
    groups = compile_patterns(spec("(?P<word>[a-z]+)(?P<digits>[0-9]+)"))
    assert compile_template("$word/${digits}/$missing$$", groups) == r"$1/$2/\$"
    assert compile_template("$1a-${1}0", groups) == r"-$1\0"


def test_literals_reach_the_scan(spark, corpus, tmp_path):
    corpus(a="x Apache y", b="z").write.parquet(str(tmp_path / "t"))
    plan = match.grep(spark.read.parquet(str(tmp_path / "t")), spec("Apache"))._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,Apache)" in plan and "Exchange" not in plan


def test_patterns_from_texts_and_tables(spark):
    assert match.patterns_of("a\r\n\nb\n") == ("a", "", "b")
    assert match.patterns_of("") == ()
    own = spark.createDataFrame([("a\r",), ("b",), (None,)], "pattern string")
    assert match.patterns_from(own) == ("a", "b")


def test_attribution(spark, corpus):
    table = spark.createDataFrame([(1, "a"), (2, "^b"), (3, None)], "pattern_id int, pattern string")
    rows = match.attribute(corpus(x="ab\nba\n"), table).collect()
    assert sorted((r.line_number, r.pattern_id) for r in rows) == [(1, 1), (2, 1), (2, 2)]


def test_binary(spark):
    rows = [("a", False, bytearray(b"needle\0tail\n")), ("b", True, bytearray(b"needle\n\0tail\n")), ("c", False, bytearray(b"needle\n")), ("d", True, bytearray(b"x" * 70000 + b"\0needle"))]
    own = spark.createDataFrame(rows, "path string, is_explicit boolean, content binary")
    got = {m: {r.path: (r.binary_offset, r.matched, r.show_lines, r.record) for r in match.binary_policy(own, spec("needle"), m).collect()} for m in ("auto", "search", "text")}
    assert got["auto"] == {"a": (6, False, False, False), "b": (7, True, False, True), "c": (None, True, True, False), "d": (70000, True, False, True)}
    assert got["search"]["a"] == (6, True, False, True)
    assert got["text"]["a"] == (None, True, True, False)


@pytest.mark.parametrize(("few", "most"), [(match.PATTERNS_A_PASS, 10**6), (3, 10**6), (3, 0)])
def test_pattern_tables_of_any_size(spark, monkeypatch, few, most):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(80)]
    texts = [(k, "\n".join(" ".join(rng.choice(words) + "x" * rng.randrange(2) for _ in range(5)) for _ in range(6)) + "\n\nq\nde") for k in range(20)] + [(30, None), (31, "")]
    docs, patterns = spark.createDataFrame(texts, "doc_id int, text string"), [*(w + " " + v for w, v in zip(words, words[1:])), "dd", "q", "ab", "aaaa", None, "abc\r", "d\ne", "🙂 long pattern"]
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    monkeypatch.setattr(match, "PATTERNS_A_PASS", few)
    monkeypatch.setattr(pattern_index, "MOST_CHARS", most)
    own = {p.removesuffix("\r") for p in patterns if p is not None}
    want = sorted((k, n, line) for k, t in texts if t for n, line in enumerate(t.split("\n"), 1) if any(p in line for p in own))
    found = match.grep_table(docs, table)
    assert sorted(map(tuple, found.collect())) == want
    if most and few == 3:
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert match.grep_table(docs, table.limit(0)).count() == 0
    every = match.grep_table(docs, table.unionByName(spark.createDataFrame([("",)], "pattern string")))
    assert every.count() == sum(len(t.split("\n")) for _, t in texts if t)


@pytest.mark.parametrize("most", [10**6, 0])
def test_attribution_of_many(spark, monkeypatch, most):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    texts = [(k, "\n".join(" ".join(rng.choice(words) for _ in range(6)) for _ in range(5))) for k in range(15)] + [(20, None)]
    plain = [f"{w} {v}" for w, v in zip(words, words[1:])]
    patterns = [*plain, *(f"{w} .*{v}$" for w, v in zip(words, words[3:])), "ab|cd", "a.c", "[ab]c+d", "abc+", "b.?d", "", None]
    table = spark.createDataFrame([*enumerate(patterns), (0, patterns[0]), (None, "dab")], "pattern_id int, pattern string")
    monkeypatch.setattr(pattern_index, "MOST_CHARS", most)
    monkeypatch.setattr(match, "PATTERNS_A_PASS", 4)
    rows = match.attribute(spark.createDataFrame(texts, "doc_id int, text string"), table).collect()
    own = [*enumerate(patterns), (None, "dab")]
    want = [(d, n, k) for d, t in texts if t for n, line in enumerate(t.split("\n"), 1) for k, p in own if p is not None and re.search(p, line)]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str) and len(want) > 200


def test_patterns_that_need_one_text_are_looked_up_once(spark, monkeypatch):
    sizes, indexed = [], pattern_index.indexed
    monkeypatch.setattr(pattern_index, "indexed", lambda lines, index, **more: sizes.append(len(index.numbers)) or indexed(lines, index, **more))
    table = spark.createDataFrame([(k, f"needed .*w{k % 50}$") for k in range(2000)], "pattern_id int, pattern string")
    lines = [f"x needed y w{k}" for k in range(60)] + ["w1", "needed", "é needed  w7"]
    rows = match.attribute(spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string"), table).collect()
    assert sizes == [1]
    assert sorted((r.line_number, r.pattern_id) for r in rows) == sorted((n, k) for n, line in enumerate(lines, 1) for k in range(2000) if re.search(f"needed .*w{k % 50}$", line))


def test_parts_of_patterns_in_order():
    parts = lambda p, **options: in_order(spec(p, **options))
    assert parts("abc,? .*de") == [("abc, ", "abc "), ("de",)]
    assert parts(r".*a\.b-c.*d?.*é.*") == [("a.b-c",), ("é",)]
    assert parts("colou?r") == [("colour", "color")] and parts(".*") == [] == parts("")
    for p in ("a.*b$", "^a.*b", "a.b", "a.+b", "a.*?b", "a.*+b", "ab??c", "ab?+c", "ab*c", "a{2}b", "a|b", "(a).*b", r"a\db", "[ab]c", "a.**b", "a?b?c?d?"):
        assert parts(p) is None
    assert parts("a.*b", case="ignore") is None and parts("a.*b", boundary="word") is None and parts("a.*b", fixed=True) is None and parts("a.*b", null_data=True) is None


@pytest.mark.parametrize("most", [10**6, 0])
def test_texts_behind_others_need_no_expression(spark, monkeypatch, most):
    rng = random.Random(9)
    words = ["".join(rng.choices("abé", k=rng.choice([3, 4, 4, 5, 9, 20]))) for _ in range(25)]
    pairs = [f"{rng.choice(words)}{rng.choice(['', ',?', 'x? '])}.*{rng.choice([*words, 'b', 'x?', 'x?ab'])}" for _ in range(120)]
    patterns = [*pairs, *words[:5], f"{words[0]},?a", f"{words[1]}.*{words[2]}.*{words[3]}", f"{words[1]}.*{words[2]}$", f"{words[4]}.*{words[4]}", f"{words[4]}.{words[5]}", "ab.*b"]
    texts = [(k, "\n".join(rng.choice(["", ", ", " "]).join(rng.choices(words, k=rng.randrange(8))) for _ in range(8))) for k in range(12)] + [(20, None)]
    monkeypatch.setattr(pattern_index, "MOST_CHARS", most)
    rows = match.attribute(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame([*enumerate(patterns)], "pattern_id int, pattern string")).collect()
    want = [(d, n, k) for d, t in texts if t for n, line in enumerate(t.split("\n"), 1) for k, p in enumerate(patterns) if re.search(p, line)]
    assert sorted(map(tuple, rows)) == sorted(want) and len(want) > 400


def test_only_finds_leave_the_lookup(spark, monkeypatch):
    found, indexed = [], pattern_index.indexed
    monkeypatch.setattr(pattern_index, "indexed", lambda *own, **more: found.append(indexed(*own, **more)) or found[-1])
    table = spark.createDataFrame([(k, f"needed,? .*w{k % 50:02}") for k in range(500)], "pattern_id int, pattern string")
    lines = [f"w{k:02} x needed{',' * (k % 2)} y w{k % 7:02}" for k in range(60)] + ["w01", "needed", "needed", "needed; w01"]
    rows = match.attribute(spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string"), table).collect()
    assert len(rows) == 600
    assert [r.line for r in found[0].collect()] == [None] * 60


@pytest.mark.parametrize(("window", "at_once"), [(1 << 18, 1 << 22), (7, 5), (11, 200)])
def test_texts_behind_others(monkeypatch, window, at_once):
    monkeypatch.setattr(pattern_index, "WINDOW", window)
    monkeypatch.setattr(pattern_index, "AT_ONCE", at_once)
    rng = random.Random(10)
    words = list({"".join(rng.choices("ab", k=rng.choice([1, 3, 4, 5, 9, 20]))) for _ in range(30)})
    numbers = [5 * rng.randrange(15) for _ in words]
    own = {n: [w for w, m in zip(words, numbers) if m == n] for n in numbers}
    pairs = [(a, b, -1 - k) for k, (a, b) in enumerate({(rng.choice(numbers), rng.choice(numbers)) for _ in range(60)})]
    alone = [n for n in own if n % 2]
    lines = ["".join(rng.choices("ab", k=rng.randrange(60))) for _ in range(50)] + ["", "a", "ab" * 500]
    first, last = lambda line, n: min((line.find(w) + len(w) for w in own[n] if w in line), default=10**6), lambda line, n: max(line.rfind(w) for w in own[n])
    want = sorted([(i, n) for i, line in enumerate(lines) for n in alone if any(w in line for w in own[n])] + [(i, p) for i, line in enumerate(lines) for a, b, p in pairs if first(line, a) <= last(line, b)])
    line, number = pattern_index.GramIndex(words, numbers, np.array(pairs), np.array(alone)).found(lines)
    assert [*zip(line.tolist(), number.tolist())] == want and len(want) > 500


def test_words_are_compared_byte_by_byte(monkeypatch):
    rng = random.Random(8)
    for window, at_once in ((1 << 18, 1 << 22), (7, 5)):
        monkeypatch.setattr(pattern_index, "WINDOW", window)
        monkeypatch.setattr(pattern_index, "AT_ONCE", at_once)
        for letters in ("ab", "abé🙂"):
            words = ["".join(rng.choices(letters, k=rng.choice([1, 3, 5, 8, 9, 13, 20, 70, 90]))) for _ in range(25)]
            lines = ["".join(rng.choices(letters, k=rng.randrange(40))) + rng.choice([*words, ""]) for _ in range(40)] + [""]
            want = sorted({(i, k) for i, line in enumerate(lines) for k, w in enumerate(words) if w in line})
            index = pattern_index.GramIndex(words, [*range(len(words))])
            line, number = index.found(lines)
            assert [*zip(line.tolist(), number.tolist())] == want
            assert index.lines_found(pa.array(lines)).tolist() == sorted({i for i, _ in want})


def test_a_line_is_left_once_a_pattern_is_found(monkeypatch):
    compared, held = [], pattern_index.GramIndex._held
    monkeypatch.setattr(pattern_index.GramIndex, "_held", lambda self, data, word, start: compared.append(len(word)) or held(self, data, word, start))
    words = [f"w{k:06}" for k in range(3000)] + [f"v{k:03}" for k in range(900)]
    lines = [" ".join(words)] * 3 + ["w00000", "v007", "w000x"]
    assert pattern_index.GramIndex(words, range(len(words))).lines_found(pa.array(lines)).tolist() == [0, 1, 2, 4]
    assert sum(compared) == 4


def test_a_hundred_thousand_patterns(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(6, 20))) for _ in range(100_000)]
    index = pattern_index.GramIndex(words, [*range(len(words))])
    lines = [" ".join([rng.choice(words)[:-1], *rng.choices(words, k=k % 3), "🙂", "pad" * 40]) for k in range(3000)] + ["", "x"]
    line, number = index.found(lines)
    places = {w: k for k, w in enumerate(words)}
    want = sorted({(k, places[own[a:b]]) for k, own in enumerate(lines) for a in range(len(own)) for b in range(a + 6, min(a + 20, len(own) + 1)) if own[a:b] in places and words[places[own[a:b]]] == own[a:b]})
    assert [*zip(line.tolist(), number.tolist())] == want and len(want) > 2500
    assert pattern_index.GramIndex(["ab"], [1]).found([])[0].tolist() == []


def test_long_lines_are_hashed_in_windows(monkeypatch):
    monkeypatch.setattr(pattern_index, "WINDOW", 7)
    words = ["abcdefghijklmnop", "nop", "q", "zz"]
    line, number = pattern_index.GramIndex(words, [0, 1, 2, 3]).found(["xxabcdefghijklmnopq", "no", "z", "zzz"])
    assert [*zip(line.tolist(), number.tolist())] == [(0, 0), (0, 1), (0, 2), (3, 3)]
