import pytest

from trawl.functions.globs import compile_glob
from trawl.operators import filters
from trawl.sources.files import matching_paths
from trawl.spec import SpecError


@pytest.fixture
def paths(spark):
    return lambda *p: spark.createDataFrame([(x,) for x in p], "path string")


def left(df):
    return sorted(r.path for r in df.collect())


def test_globs(paths):
    own = paths("keep.swift", "skip.txt", "a/b/keep.swift", "a/keep.md")
    assert left(filters.glob_filter(own, ["*.swift"])) == ["a/b/keep.swift", "keep.swift"]
    assert left(filters.glob_filter(own, ["!skip.txt"])) == ["a/b/keep.swift", "a/keep.md", "keep.swift"]
    assert left(filters.glob_filter(own, [], insensitive=["!*.TXT"])) == ["a/b/keep.swift", "a/keep.md", "keep.swift"]
    assert left(filters.glob_filter(own, ["!*.TXT"], case_insensitive=True)) == ["a/b/keep.swift", "a/keep.md", "keep.swift"]
    assert left(filters.glob_filter(own, ["!a/**", "a/*.md"])) == ["a/keep.md"]
    assert left(filters.glob_filter(own, ["a/"])) == ["a/b/keep.swift", "a/keep.md"]
    assert left(filters.glob_filter(own, ["/keep.*"])) == ["keep.swift"]


@pytest.mark.parametrize(
    ("glob", "path", "found"),
    [
        ("*.[ch]", "x.c", True),
        ("*.[!ch]", "x.c", False),
        ("{a,b*}.py", "bc.py", True),
        ("**/x", "a/b/x", True),
        ("a/**/x", "a/x", True),
        ("a/**", "a", False),
        ("a?c", "a/c", False),
        (r"\*", "*", True),
        ("a.c", "abc", False),
    ],
)
def test_glob_language(paths, glob, path, found):
    assert bool(matching_paths(paths(path), glob).count()) is found


def test_bad_globs():
    for glob in ("{a", "[a"):
        with pytest.raises(SpecError):
            compile_glob(glob)


def test_hidden(paths):
    own = paths("visible.txt", ".hidden.txt", ".hidden-dir/nested.txt", "a/..b/c", "a/b..c")
    assert left(filters.hidden_filter(own)) == ["a/b..c", "visible.txt"]
    assert ".hidden.txt" in left(filters.hidden_filter(own, keep=own.path.endswith(".txt")))


def rules(spark, *sources):
    return spark.createDataFrame([r for s in sources for r in filters.parse_rules(*s)], filters.RULES)


def test_ignore(spark, paths):
    own = paths("keep.txt", "skip.log")
    assert left(filters.ignore_filter(own, rules(spark, ("*.log\n",)))) == ["keep.txt"]
    assert left(filters.ignore_filter(own, rules(spark, ("*.log\n",)), sources=["vcs"])) == ["keep.txt", "skip.log"]
    assert left(filters.ignore_filter(paths("src/llvm/foo"), rules(spark, ("/llvm/",)))) == ["src/llvm/foo"]
    assert left(filters.ignore_filter(paths("llvm/foo", "llvm"), rules(spark, ("/llvm/",)))) == ["llvm"]


def test_ignore_precedence(spark, paths):
    own = paths("a.log", "b.log", "build/x", "build/keep", "sub/a.log", "sub/b.log", "A.LOG", "#x", "sub/deep/c.tmp")
    r = rules(spark, ("# note\n\n*.log\n!b.log\nbuild/\n!build/keep\n\\#x\n", "", "dot", 0), ("!a.log\nb.log\ndeep/*.tmp\n", "sub", "vcs", 1))
    assert left(filters.ignore_filter(own, r)) == ["A.LOG", "b.log", "sub/a.log"]
    r = rules(spark, ("*.log\n", "", "explicit", 0, True))
    assert left(filters.ignore_filter(paths("A.LOG", "x"), r)) == ["x"]


def test_types(paths):
    own, types = paths("Sources/main.swift", "Sources/main.rs", "README.md", ".hidden.swift"), filters.FileTypes()
    assert left(filters.type_filter(own, types, [("select", "swift")])) == [".hidden.swift", "Sources/main.swift"]
    assert left(filters.type_filter(own, types, [("negate", "swift")])) == ["README.md", "Sources/main.rs"]
    assert left(filters.type_filter(own, types, [("select", "all")])) == sorted(r.path for r in own.collect())
    assert left(filters.type_filter(own, types, [("negate", "swift"), ("select", "swift")])) == [".hidden.swift", "Sources/main.swift"]
    with pytest.raises(SpecError):
        filters.type_filter(own, types, [("select", "nothing")])


def test_type_edits(spark, paths):
    own = paths("one.foo", "one.txt", "two.swift", "three.rs")
    types = filters.FileTypes().add("foo:*.foo").add("mine:include:foo,swift").clear("rust")
    assert left(filters.type_filter(own, types, [("select", "mine")])) == ["one.foo", "two.swift"]
    with pytest.raises(SpecError):
        filters.type_filter(own, types, [("select", "rust")])
    listed = {r["name"]: r["globs"] for r in filters.list_types(spark, types).collect()}
    assert listed["mine"] == "*.foo, *.swift" and listed["py"] == "*.py, *.pyi" and "rust" not in listed
    assert filters.FileTypes.of(types.frame(spark)).types == types.types
    tags = sorted((r.path, r.type) for r in filters.tag_types(own, types).collect())
    assert tags == [("one.foo", "foo"), ("one.foo", "mine"), ("one.txt", "txt"), ("two.swift", "mine"), ("two.swift", "swift")]


def test_limits(spark):
    own = spark.createDataFrame([("", 5), ("a", 1024), ("a/b", 1025)], "path string, length long")
    assert left(filters.limit_depth(own, 0)) == [""] and left(filters.limit_depth(own, 1)) == ["", "a"]
    assert left(filters.limit_size(own, 1024)) == ["", "a"]


def test_reasons(spark):
    own = spark.createDataFrame([("a.txt", 1), (".b.txt", 1), (".d/i.txt", 1), (".h.rs", 1), ("c.log", 1), ("d.rs", 1), ("e.txt", 99), ("x/y/f.txt", 1), ("g.bad", 1)], "path string, length long")
    r = rules(spark, ("*.log\n",))
    out = filters.explain_filters(own, globs=["!*.bad"], rules=r, types=filters.FileTypes(), selections=[("select", "txt")], max_depth=2, max_size=50)
    assert {x.path: x.skip_reason for x in out.collect()} == {"a.txt": None, ".b.txt": None, ".d/i.txt": "hidden", ".h.rs": "hidden", "c.log": "ignore", "d.rs": "type", "e.txt": "size", "x/y/f.txt": "depth", "g.bad": "glob"}
    plain = filters.explain_filters(own, globs=["!*.bad"], rules=r, max_depth=2, max_size=50)
    assert {x.path for x in plain.filter("skip_reason = 'hidden'").collect()} == {".b.txt", ".d/i.txt", ".h.rs"}


def test_negated_and_selected_types(spark):
    own = spark.createDataFrame([("a.py",), ("b.rs",), ("c.md",), ("d.xyz",)], "path string")
    left = lambda *s: {r.path for r in filters.type_filter(own, filters.FileTypes(), s).collect()}
    assert left(("negate", "all"), ("select", "rust")) == {"b.rs"} and left(("negate", "all")) == {"d.xyz"}
    assert left(("select", "all"), ("negate", "md")) == {"a.py", "b.rs"} and left(("negate", "rust"), ("select", "all")) == {"a.py", "b.rs", "c.md"}
    assert left(("select", "py"), ("negate", "py")) == set() and left(("negate", "py"), ("select", "py")) == {"a.py"}


def test_no_nested_loops(spark):
    own = spark.createDataFrame([(1, "src/a.tar.gz"), (2, "src/build/x.o"), (3, "b.log"), (4, "keep/b.log"), (5, "src/a.gz.txt")], "n int, path string")
    r = rules(spark, ("*.gz\nbuild/\n*.log\n!/keep/*.log\n[xyz].q\n",))
    found = filters.ignore_decisions(own, r)
    assert {x.path: x.decision for x in found.collect()} == {"src/a.tar.gz": "exclude", "src/build/x.o": "exclude", "b.log": "exclude", "keep/b.log": "include", "src/a.gz.txt": None}
    tagged = filters.tag_types(own, filters.FileTypes())
    assert {(x.n, x.type) for x in tagged.collect()} == {(1, "gzip"), (3, "log"), (4, "log"), (5, "txt")}
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (found, tagged, filters.ignore_filter(own, r))]
    assert not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def test_many_rules(spark):
    own = spark.createDataFrame([(f"d{k}/f{j}.e{j}",) for k in range(4) for j in range(30)], "path string")
    lines = [f"/d{k}/f{j}.e{j}" if (k + j) % 2 else f"!d{k}/*.e{j}" for k in range(4) for j in range(30)] + [f"*.e{j}" for j in range(0, 30, 3)]
    found = {x.path: x.decision for x in filters.ignore_decisions(own, rules(spark, ("\n".join(lines),))).collect()}
    assert all(found[f"d{k}/f{j}.e{j}"] == ("exclude" if j % 3 == 0 or (k + j) % 2 else "include") for k in range(4) for j in range(30))


@pytest.mark.parametrize("few", [filters.FEW_RULES, 10**6])
def test_looked_up_rules_decide_like_tried_ones(spark, monkeypatch, few):
    monkeypatch.setattr(filters, "FEW_RULES", few)
    names = ["alpha", "beta", "gamma.txt", "delta.md", "x-1", "dir"]
    paths_ = [f"{a}/{b}/{c}" for a in names for b in names for c in names] + [f"{a}/{c}" for a in names for c in names] + names
    own = spark.createDataFrame([(p,) for p in paths_] + [(None,)], "path string")
    lines = ["/alpha/*.md", "!alpha/delta.md", "beta/**/x-?", "**/dir/gam*", "dir/", "!/dir/", "x-[0-9]/del*", "{alpha,beta}/dir", "gamma.txt/*", "!gamma.txt/beta"] + [f"/alpha/none{k}/*.y{k}" for k in range(30)]
    got = {r.path: r.decision for r in filters.ignore_decisions(own, rules(spark, ("\n".join(lines),))).collect()}
    assert set(got) == set(paths_) and len(got) == len(paths_)
    if few == 10**6:
        assert got == test_looked_up_rules_decide_like_tried_ones.held and {"include", "exclude", None} == set(got.values())
    else:
        test_looked_up_rules_decide_like_tried_ones.held = got


def test_ten_thousand_rules_in_one_pass(spark):
    lines = [f"/src{k % 40}/part{k}/*.gen{k % 7}" for k in range(10_000)]
    own = spark.createDataFrame([(f"src{k % 40}/part{k}/f.gen{k % 5}",) for k in range(0, 20_000, 7)], "path string")
    found = filters.ignore_filter(own, rules(spark, ("\n".join(lines),)))
    want = [f"src{k % 40}/part{k}/f.gen{k % 5}" for k in range(0, 20_000, 7) if k >= 10_000 or k % 7 != k % 5]
    assert sorted(r.path for r in found.collect()) == sorted(want)
