import random
import re

import pytest
from pyspark.sql import functions as F

from trawl.operators import context, spans
from trawl.spec import spec


def test_columns_and_replacement(corpus):
    own = corpus(a="abc123 def456\n")
    assert [(r.start_column, r.text) for r in spans.spans(own, spec("[0-9]+")).orderBy("span_index").collect()] == [(4, "123"), (11, "456")]
    assert spans.replace(own, spec("[0-9]+", template="NUM")).first().line == "abcNUM defNUM"


def test_replace(corpus):
    own = corpus(a="foo bar foo\nqux\nfoo\n")
    rows = spans.match_rows(own, spec("foo", template="X")).orderBy("line_number").collect()
    assert [(r.line_number, r.absolute_offset) for r in rows] == [(1, 0), (3, 16)]
    each = spans.spans(own, spec("foo", template="X")).orderBy("line_number", "span_index").collect()
    assert [(r.start_column, r.replaced_column, r.replacement) for r in each] == [(1, 1, "X"), (9, 7, "X"), (1, 1, "X")]


def test_named_replacement(corpus):
    search = spec("(?P<word>[a-z]+)(?P<digits>[0-9]+)", template="$word/$digits/$missing")
    assert spans.replace(corpus(a="abc123\n"), search).first().line == "abc/123/"
    assert [r.text for r in spans.only_matching(corpus(a="x abc123 def4\n"), search).orderBy("span_index").collect()] == ["abc/123/", "def/4/"]


def test_max_count_keeps_all_matches_of_its_lines(corpus):
    own = corpus(a="y" * 5000 + "\nrare rare\nno\nrare\n")
    assert len(spans.only_matching(own, spec("rare", max_count=1)).collect()) == 2


@pytest.mark.parametrize(
    ("pattern", "text", "found"),
    [("a*", "baac", [(0, ""), (1, "aa"), (4, "")]), ("", "ab", [(0, ""), (1, ""), (2, "")]), ("x?", "x", [(0, "x")]), ("^", "ab", [(0, "")]), ("$", "ab", [(2, "")])],
)
def test_empty_matches(corpus, pattern, text, found):
    rows = spans.spans(corpus(a=text), spec(pattern)).orderBy("span_index").collect()
    assert [(r.start_byte, r.text) for r in rows] == found


def test_spans_rebuild_lines(spark):
    rng = random.Random(7)
    rows = [(str(k), "".join(rng.choice("abé ﷐﷑xλ") for _ in range(rng.randrange(30)))) for k in range(300)]
    rows = [(k, t) for k, t in rows if t]
    own = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r.spans for r in spans.match_rows(own, spec("[ab]+é?")).collect()}
    for path, text in rows:
        want = [m.span() for m in re.finditer("[ab]+é?", text)]
        data = text.encode()
        assert [(len(text[:a].encode()), len(text[:b].encode())) for a, b in want] == [(s.start_byte, s.end_byte) for s in got.get(path, [])]
        assert all(data[s.start_byte : s.end_byte].decode() == s.text for s in got.get(path, []))


def test_captures(corpus):
    rows = spans.captures(corpus(a="k1=v1 k2=v2\n"), spec(r"(?P<key>\w+)=(\w+)")).orderBy("match_index", "group").collect()
    assert [(r.match_index, r.group, r.name, r.value) for r in rows] == [(0, 0, None, "k1=v1"), (0, 1, "key", "k1"), (0, 2, None, "v1"), (1, 0, None, "k2=v2"), (1, 1, "key", "k2"), (1, 2, None, "v2")]


def test_multiline(corpus):
    r = spans.search_multiline(corpus(a="foo\nbar\nbaz\n"), spec("foo\nbar", multiline=True)).first()
    assert (r.start_byte, r.end_byte, r.first_line, r.last_line) == (0, 7, 1, 2)
    own = corpus(a="xxx\nabc\ndefxxxabc\ndefxxx\nxxx")
    assert sorted(r.line_number for r in spans.lines_covered(own, spec("abc\ndef", multiline=True)).collect()) == [2, 3, 4]
    assert not spans.search_multiline(corpus(a="a\nb"), spec("a.b", multiline=True)).collect()
    assert spans.search_multiline(corpus(a="a\nb"), spec("a.b", multiline=True, dotall=True)).collect()
    assert [r.first_line for r in spans.search_multiline(corpus(a="a\nb\na\n"), spec("^a$", multiline=True)).orderBy("span_index").collect()] == [1, 3]


def test_rewrite_keeps_line_ends(corpus):
    rows = spans.rewrite(corpus(a="x1\ny\n", b="1\n2", c="", d=None), spec(r"\d", template="#")).collect()
    assert {r.path: r.text for r in rows} == {"a": "x#\ny\n", "b": "#\n#", "c": "", "d": None}


def test_first_column(corpus):
    own = corpus(a="éa", b="b").withColumn("n", spans.first_column(spec("a"), F.col("text")))
    assert {r.path: r.n for r in own.collect()} == {"a": 3, "b": None}


def test_no_shuffle(corpus):
    plan = spans.match_rows(corpus(a="x"), spec("[a-z]"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_time_in_proportion(spark):
    """A line of 100,000 matches and a text of 100,000 lines; anything quadratic would take hours here."""
    n = 100_000
    line = spark.createDataFrame([("p", "é1 " * n)], "path string, text string")
    rows = spans.spans(line, spec("[0-9]", template="<$0>")).agg(F.count("*"), F.sum("start_byte"), F.sum("replaced_column"), F.max("span_index")).first()
    assert tuple(rows) == (n, sum(4 * k + 2 for k in range(n)), sum(6 * k + 3 for k in range(n)), n - 1)
    text = spark.createDataFrame([("p", "a 1\nb\n" * (n // 2))], "path string, text string")
    covered = spans.search_multiline(text, spec("1\\nb", multiline=True)).agg(F.count("*"), F.sum("first_line"), F.sum("last_line")).first()
    assert tuple(covered) == (n // 2, sum(range(1, n, 2)), sum(range(2, n + 1, 2)))
    shown = context.selected(text, spec("1", passthru=True)).agg(F.count("*"), F.sum("absolute_offset"), F.max("group_id"), F.count_if(F.col("role") == "match")).first()
    assert tuple(shown) == (n, sum(6 * k + 6 * k + 4 for k in range(n // 2)), 1, n // 2)
    groups = context.selected(text, spec("1")).agg(F.count("*"), F.max("group_id")).first()
    assert tuple(groups) == (n // 2, n // 2)


def test_texts_that_hold_the_fences(spark):
    rng = random.Random(21)
    marks = ["﷐", "﷑", "﷒", "﷓"]
    texts = ["﷐﷑﷒﷓ ab", *("".join(rng.choice([*marks, *"ab "]) for _ in range(rng.randrange(1, 25))) for _ in range(300))]
    own = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    for pattern in ("ab", "a+", "﷐+", "[^a]", "(a|﷑)(﷐?)", "﷐﷑"):
        template = "$0" + spans.FENCE + "<$0>"
        got = {}
        for r in spans.spans(own, spec(pattern, template=template)).collect():
            got.setdefault(r.id, []).append((r.span_index, r.start_byte, r.end_byte, r.text, r.replacement))
        for k, text in enumerate(texts):
            size = lambda end: len(text[:end].encode())  # noqa: B023, E731
            want = [(i, size(m.start()), size(m.end()), m[0], f"{m[0]}{spans.FENCE}<{m[0]}>") for i, m in enumerate(re.finditer(pattern, text))]
            assert sorted(got.get(k, [])) == want, (pattern, text)
