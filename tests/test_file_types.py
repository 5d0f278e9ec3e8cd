from trawl.operators import filters


def test_all_default_types(spark):
    types = filters.FileTypes()
    assert len(types.types) == 224
    own = {"run.sh": "sh", "Makefile": "make", "a.R": "r", "p.tex": "tex", "m.f90": "fortran", "x.lhs": "haskell", "y.mli": "ocaml", "z.lisp": "lisp", "v.vh": "verilog", ".vimrc": "vim", "LICENSE-MIT": "license", "i.hh": "h", "go.cmd": "cmd", "q.bat": "batch", "u.mts": "typescript", "w.proto": "protobuf"}
    paths = spark.createDataFrame([(p,) for p in own] + [("none.unknown",)], "path string")
    found = {(r.path, r.type) for r in filters.tag_types(paths, types).collect()}
    assert set(own.items()) <= found and all(p != "none.unknown" for p, _ in found)
    assert {r.path for r in filters.type_filter(paths, types, [("select", "all")]).collect()} == set(own)
    assert filters.list_types(spark, types).count() == 224
