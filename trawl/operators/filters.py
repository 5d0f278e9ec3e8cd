"""Filters on paths and metadata, before any content is read. Paths are relative, with / between components."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.globs import compile_glob
from trawl.operators import pattern_index
from trawl.sources.written import written_once
from trawl.spec import SpecError

#: Most rules or type globs that are gathered on the driver or broadcast.
MOST_RULES = 100_000

RULES = "scope_dir string, source string, source_rank int, seq int, pattern string, decision string, dir_only boolean, anchored boolean, basename_only boolean, case_insensitive boolean"

# The default file types, aliases as names of their own. A registry of one's own is a parameter of FileTypes.
FILE_TYPES = {
    "ada": ["*.adb", "*.ads"],
    "agda": ["*.agda", "*.lagda"],
    "aidl": ["*.aidl"],
    "alire": ["alire.toml"],
    "amake": ["*.mk", "*.bp"],
    "asciidoc": ["*.adoc", "*.asc", "*.asciidoc"],
    "asm": ["*.asm", "*.s", "*.S"],
    "asp": ["*.aspx", "*.aspx.cs", "*.aspx.vb", "*.ascx", "*.ascx.cs", "*.ascx.vb", "*.asp"],
    "ats": ["*.ats", "*.dats", "*.sats", "*.hats"],
    "avro": ["*.avdl", "*.avpr", "*.avsc"],
    "awk": ["*.awk"],
    "bat": ["*.bat"],
    "batch": ["*.bat"],
    "bazel": ["*.bazel", "*.bzl", "*.BUILD", "*.bazelrc", "BUILD", "MODULE.bazel", "WORKSPACE", "WORKSPACE.bazel", "WORKSPACE.bzlmod"],
    "bitbake": ["*.bb", "*.bbappend", "*.bbclass", "*.conf", "*.inc"],
    "boxlang": ["*.bx", "*.bxm", "*.bxs"],
    "brotli": ["*.br"],
    "buildstream": ["*.bst"],
    "bzip2": ["*.bz2", "*.tbz2"],
    "c": ["*.[chH]", "*.[chH].in", "*.cats"],
    "cabal": ["*.cabal"],
    "candid": ["*.did"],
    "carp": ["*.carp"],
    "cbor": ["*.cbor"],
    "ceylon": ["*.ceylon"],
    "cfml": ["*.cfc", "*.cfm"],
    "clojure": ["*.clj", "*.cljc", "*.cljs", "*.cljx"],
    "cmake": ["*.cmake", "CMakeLists.txt"],
    "cmd": ["*.bat", "*.cmd"],
    "cml": ["*.cml"],
    "coffeescript": ["*.coffee"],
    "config": ["*.cfg", "*.conf", "*.config", "*.ini"],
    "container": ["*Containerfile*", "*Dockerfile*"],
    "coq": ["*.v"],
    "cpp": ["*.[ChH]", "*.cc", "*.[ch]pp", "*.[ch]xx", "*.hh", "*.inl", "*.[ChH].in", "*.cc.in", "*.[ch]pp.in", "*.[ch]xx.in", "*.hh.in"],
    "creole": ["*.creole"],
    "crystal": ["Projectfile", "*.cr", "*.ecr", "shard.yml"],
    "cs": ["*.cs"],
    "csharp": ["*.cs"],
    "cshtml": ["*.cshtml"],
    "csproj": ["*.csproj"],
    "css": ["*.css", "*.scss"],
    "csv": ["*.csv"],
    "cuda": ["*.cu", "*.cuh"],
    "cython": ["*.pyx", "*.pxi", "*.pxd"],
    "d": ["*.d"],
    "dart": ["*.dart"],
    "devicetree": ["*.dts", "*.dtsi", "*.dtso"],
    "dhall": ["*.dhall"],
    "diff": ["*.patch", "*.diff"],
    "dita": ["*.dita", "*.ditamap", "*.ditaval"],
    "docker": ["*Dockerfile*"],
    "dockercompose": ["docker-compose.yml", "docker-compose.*.yml"],
    "dts": ["*.dts", "*.dtsi"],
    "dvc": ["Dvcfile", "*.dvc"],
    "ebuild": ["*.ebuild", "*.eclass"],
    "edn": ["*.edn"],
    "elisp": ["*.el"],
    "elixir": ["*.ex", "*.eex", "*.exs", "*.heex", "*.leex", "*.livemd"],
    "elm": ["*.elm"],
    "erb": ["*.erb"],
    "erlang": ["*.erl", "*.hrl"],
    "fennel": ["*.fnl"],
    "fidl": ["*.fidl"],
    "fish": ["*.fish"],
    "flatbuffers": ["*.fbs"],
    "fortran": ["*.f", "*.F", "*.f77", "*.F77", "*.pfo", "*.f90", "*.F90", "*.f95", "*.F95"],
    "fsharp": ["*.fs", "*.fsx", "*.fsi"],
    "fut": ["*.fut"],
    "gap": ["*.g", "*.gap", "*.gi", "*.gd", "*.tst"],
    "gdscript": ["*.gd"],
    "gleam": ["*.gleam"],
    "gn": ["*.gn", "*.gni"],
    "go": ["*.go"],
    "gprbuild": ["*.gpr"],
    "gradle": ["*.gradle", "*.gradle.kts", "gradle.properties", "gradle-wrapper.*", "gradlew", "gradlew.bat"],
    "graphql": ["*.graphql", "*.graphqls"],
    "groovy": ["*.groovy", "*.gradle"],
    "gzip": ["*.gz", "*.tgz"],
    "h": ["*.h", "*.hh", "*.hpp"],
    "haml": ["*.haml"],
    "hare": ["*.ha"],
    "haskell": ["*.hs", "*.lhs", "*.cpphs", "*.c2hs", "*.hsc"],
    "hbs": ["*.hbs"],
    "hs": ["*.hs", "*.lhs"],
    "html": ["*.htm", "*.html", "*.ejs"],
    "hurl": ["*.hurl"],
    "hy": ["*.hy"],
    "idris": ["*.idr", "*.lidr"],
    "janet": ["*.janet"],
    "java": ["*.java", "*.jsp", "*.jspx", "*.properties"],
    "jinja": ["*.j2", "*.jinja", "*.jinja2"],
    "jl": ["*.jl"],
    "js": ["*.js", "*.jsx", "*.vue", "*.cjs", "*.mjs"],
    "json": ["*.json", "composer.lock", "*.sarif"],
    "jsonl": ["*.jsonl"],
    "julia": ["*.jl"],
    "jupyter": ["*.ipynb", "*.jpynb"],
    "k": ["*.k"],
    "kconfig": ["Kconfig", "Kconfig.*"],
    "kotlin": ["*.kt", "*.kts"],
    "lean": ["*.lean"],
    "less": ["*.less"],
    "license": ["COPYING", "COPYING[.-]*", "COPYRIGHT", "COPYRIGHT[.-]*", "EULA", "EULA[.-]*", "licen[cs]e", "licen[cs]e.*", "LICEN[CS]E", "LICEN[CS]E[.-]*", "*[.-]LICEN[CS]E*", "NOTICE", "NOTICE[.-]*", "PATENTS", "PATENTS[.-]*", "UNLICEN[CS]E", "UNLICEN[CS]E[.-]*", "agpl[.-]*", "gpl[.-]*", "lgpl[.-]*", "AGPL-*[0-9]*", "APACHE-*[0-9]*", "BSD-*[0-9]*", "CC-BY-*", "GFDL-*[0-9]*", "GNU-*[0-9]*", "GPL-*[0-9]*", "LGPL-*[0-9]*", "MIT-*[0-9]*", "MPL-*[0-9]*", "OFL-*[0-9]*"],
    "lilypond": ["*.ly", "*.ily"],
    "lisp": ["*.el", "*.jl", "*.lisp", "*.lsp", "*.sc", "*.scm"],
    "llvm": ["*.ll"],
    "lock": ["*.lock", "package-lock.json"],
    "log": ["*.log"],
    "lua": ["*.lua"],
    "lz4": ["*.lz4"],
    "lzma": ["*.lzma"],
    "m4": ["*.ac", "*.m4"],
    "make": ["[Gg][Nn][Uu]makefile", "[Mm]akefile", "[Gg][Nn][Uu]makefile.am", "[Mm]akefile.am", "[Gg][Nn][Uu]makefile.in", "[Mm]akefile.in", "Makefile.*", "*.mk", "*.mak"],
    "mako": ["*.mako", "*.mao"],
    "man": ["*.[0-9lnpx]", "*.[0-9][cEFMmpSx]"],
    "markdown": ["*.markdown", "*.md", "*.mdown", "*.mdwn", "*.mkd", "*.mkdn", "*.mdx"],
    "matlab": ["*.m"],
    "md": ["*.markdown", "*.md", "*.mdown", "*.mdwn", "*.mkd", "*.mkdn", "*.mdx"],
    "meson": ["meson.build", "meson_options.txt", "meson.options"],
    "minified": ["*.min.html", "*.min.css", "*.min.js"],
    "mint": ["*.mint"],
    "mk": ["mkfile"],
    "ml": ["*.ml"],
    "mojo": ["*.mojo"],
    "motoko": ["*.mo"],
    "msbuild": ["*.csproj", "*.fsproj", "*.vcxproj", "*.proj", "*.props", "*.targets", "*.sln", "*.slnf"],
    "nim": ["*.nim", "*.nimf", "*.nimble", "*.nims"],
    "nix": ["*.nix"],
    "objc": ["*.h", "*.m"],
    "objcpp": ["*.h", "*.mm"],
    "ocaml": ["*.ml", "*.mli", "*.mll", "*.mly"],
    "org": ["*.org", "*.org_archive"],
    "pants": ["BUILD"],
    "pascal": ["*.pas", "*.dpr", "*.lpr", "*.pp", "*.inc"],
    "pdf": ["*.pdf"],
    "perl": ["*.perl", "*.pl", "*.PL", "*.plh", "*.plx", "*.pm", "*.t"],
    "php": ["*.php", "*.php3", "*.php4", "*.php5", "*.php7", "*.php8", "*.pht", "*.phtml"],
    "pkgbuild": ["PKGBUILD"],
    "po": ["*.po"],
    "pod": ["*.pod"],
    "postscript": ["*.eps", "*.ps"],
    "prolog": ["*.pl", "*.pro", "*.prolog", "*.P"],
    "proto": ["*.proto"],
    "protobuf": ["*.proto"],
    "ps": ["*.cdxml", "*.ps1", "*.ps1xml", "*.psd1", "*.psm1"],
    "puppet": ["*.epp", "*.erb", "*.pp", "*.rb"],
    "purs": ["*.purs"],
    "py": ["*.py", "*.pyi"],
    "python": ["*.py", "*.pyi"],
    "qmake": ["*.pro", "*.pri", "*.prf"],
    "qml": ["*.qml"],
    "qrc": ["*.qrc"],
    "qui": ["*.ui"],
    "r": ["*.R", "*.r", "*.Rmd", "*.rmd", "*.Rnw", "*.rnw"],
    "racket": ["*.rkt"],
    "raku": ["*.raku", "*.rakumod", "*.rakudoc", "*.rakutest", "*.p6", "*.pl6", "*.pm6"],
    "rdoc": ["*.rdoc"],
    "readme": ["README*", "*README"],
    "reasonml": ["*.re", "*.rei"],
    "red": ["*.r", "*.red", "*.reds"],
    "rescript": ["*.res", "*.resi"],
    "robot": ["*.robot"],
    "rocq": ["*.v"],
    "rst": ["*.rst"],
    "ruby": ["config.ru", "Gemfile", ".irbrc", "Rakefile", "*.gemspec", "*.rb", "*.rbw", "*.rake"],
    "rust": ["*.rs"],
    "sass": ["*.sass", "*.scss"],
    "scala": ["*.scala", "*.sbt"],
    "scdoc": ["*.scd", "*.scdoc"],
    "seed7": ["*.sd7", "*.s7i"],
    "sh": [".env", ".login", ".logout", ".profile", "profile", ".bash_login", "bash_login", ".bash_logout", "bash_logout", ".bash_profile", "bash_profile", ".bashrc", "bashrc", "*.bashrc", ".cshrc", "*.cshrc", ".kshrc", "*.kshrc", ".tcshrc", ".zshenv", "zshenv", ".zlogin", "zlogin", ".zlogout", "zlogout", ".zprofile", "zprofile", ".zshrc", "zshrc", "*.bash", "*.csh", "*.env", "*.ksh", "*.sh", "*.tcsh", "*.zsh"],
    "slim": ["*.skim", "*.slim", "*.slime"],
    "smarty": ["*.tpl"],
    "sml": ["*.sml", "*.sig"],
    "solidity": ["*.sol"],
    "soy": ["*.soy"],
    "spark": ["*.spark"],
    "spec": ["*.spec"],
    "sql": ["*.sql", "*.psql"],
    "ssa": ["*.ssa"],
    "stylus": ["*.styl"],
    "sv": ["*.v", "*.vg", "*.sv", "*.svh", "*.h"],
    "svelte": ["*.svelte", "*.svelte.ts"],
    "svg": ["*.svg"],
    "swift": ["*.swift"],
    "swig": ["*.def", "*.i"],
    "systemd": ["*.automount", "*.conf", "*.device", "*.link", "*.mount", "*.path", "*.scope", "*.service", "*.slice", "*.socket", "*.swap", "*.target", "*.timer"],
    "taskpaper": ["*.taskpaper"],
    "tcl": ["*.tcl"],
    "tex": ["*.tex", "*.ltx", "*.cls", "*.sty", "*.bib", "*.dtx", "*.ins"],
    "texinfo": ["*.texi"],
    "textile": ["*.textile"],
    "tf": ["*.tf", "*.tf.json", "*.tfvars", "*.tfvars.json", "*.terraformrc", "terraform.rc", "*.tfrc", "*.terraform.lock.hcl"],
    "thrift": ["*.thrift"],
    "toml": ["*.toml", "Cargo.lock"],
    "ts": ["*.ts", "*.tsx", "*.cts", "*.mts"],
    "twig": ["*.twig"],
    "txt": ["*.txt"],
    "typescript": ["*.ts", "*.tsx", "*.cts", "*.mts"],
    "typoscript": ["*.typoscript", "*.ts"],
    "typst": ["*.typ"],
    "usd": ["*.usd", "*.usda", "*.usdc"],
    "v": ["*.v", "*.vsh"],
    "vala": ["*.vala"],
    "vb": ["*.vb"],
    "vcl": ["*.vcl"],
    "verilog": ["*.v", "*.vh", "*.sv", "*.svh"],
    "vhdl": ["*.vhd", "*.vhdl"],
    "vim": ["*.vim", ".vimrc", ".gvimrc", "vimrc", "gvimrc", "_vimrc", "_gvimrc"],
    "vimscript": ["*.vim", ".vimrc", ".gvimrc", "vimrc", "gvimrc", "_vimrc", "_gvimrc"],
    "vue": ["*.vue"],
    "webidl": ["*.idl", "*.webidl", "*.widl"],
    "wgsl": ["*.wgsl"],
    "wiki": ["*.mediawiki", "*.wiki"],
    "xml": ["*.xml", "*.xml.dist", "*.dtd", "*.xsl", "*.xslt", "*.xsd", "*.xjb", "*.rng", "*.sch", "*.xhtml"],
    "xz": ["*.xz", "*.txz"],
    "yacc": ["*.y"],
    "yaml": ["*.yaml", "*.yml"],
    "yang": ["*.yang"],
    "z": ["*.Z"],
    "zig": ["*.zig"],
    "zsh": [".zshenv", "zshenv", ".zlogin", "zlogin", ".zlogout", "zlogout", ".zprofile", "zprofile", ".zshrc", "zshrc", "*.zsh"],
    "zstd": ["*.zst", "*.zstd"],
}

#: Rules without an index that are tried in one pass over the paths.
RULES_A_PASS, FEW_RULES = 500, 20


# Override globs


def glob_decision(path: Column, globs: Sequence[str], insensitive: Sequence[str] = ()) -> Column:
    """include, exclude or null for files: the last glob that matches decides, the insensitive ones rank after the others.

    With an include among them, files that none matches are excluded.
    """
    rules = [(g, False) for g in globs] + [(g, True) for g in insensitive]
    out = F.lit("exclude" if any(not g.startswith("!") for g, _ in rules) else None)
    for glob, ci in rules:
        body = glob.removeprefix("!")
        # A glob for directories decides for what they hold.
        regex = compile_glob(body, insensitive=ci)
        test = path.rlike(regex[:-1] + "/.+$") if body.endswith("/") else path.rlike(regex) | path.rlike(regex[:-1] + "/.+$")
        out = F.when(test, "exclude" if glob.startswith("!") else "include").otherwise(out)
    return out


def glob_filter(df: DataFrame, globs: Sequence[str], path: str = "path", insensitive: Sequence[str] = (), case_insensitive: bool = False) -> DataFrame:
    """Files that override globs leave. case_insensitive folds the case of all of them."""
    first, second = ((), (*globs, *insensitive)) if case_insensitive else (globs, insensitive)
    return df.filter(F.coalesce(glob_decision(F.col(path), first, second), F.lit("include")) == "include")


def hidden(path: Column) -> Column:
    """Whether a component starts with a dot."""
    return path.rlike(r"(^|/)\.[^/]")


def hidden_filter(df: DataFrame, path: str = "path", keep: Column | None = None) -> DataFrame:
    """Files without a hidden component, and those that keep (an override, a whitelist or a selected type) brings back."""
    return df.filter(~hidden(F.col(path)) | F.coalesce(keep, F.lit(False)) if keep is not None else ~hidden(F.col(path)))


# Ignore rules


def parse_rules(text: str, scope_dir: str = "", source: str = "dot", source_rank: int = 0, case_insensitive: bool = False) -> list[tuple]:
    """Rows of RULES from the lines of an ignore file."""
    rows = []
    for seq, line in enumerate(text.split("\n")):
        line = line.removesuffix("\r")
        if not line.strip() or line.startswith("#"):
            continue
        line = line.rstrip(" ") if not line.endswith("\\ ") else line
        keep = line.startswith("!")
        body = line[1:] if keep else line.removeprefix("\\") if line[:2] in ("\\!", "\\#") else line
        bare = body.rstrip("/")
        rows.append((scope_dir, source, source_rank, seq, bare.removeprefix("/"), "include" if keep else "exclude", body.endswith("/"), body.startswith("/") or "/" in bare, "/" not in bare, case_insensitive))
    return rows


def _index_key(pattern: str) -> str | None:
    """What a rule on base names can be looked up by: a whole name, or an ending behind a dot. None for other rules."""
    ending = pattern.removeprefix("*")
    if not ending or set(ending) & set("*?[]{}\\") or (ending != pattern and not ending.startswith(".")):
        return None
    return ("s:" if ending != pattern else "b:") + ending


def _name_keys(name: Column) -> Column:
    """The keys under which a base name's rules stand: its name and each ending behind a dot."""
    parts = F.split(name, r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("s:."), F.array_join(F.slice(parts, i + 1, F.size(parts)), ".")))
    return F.array_append(F.slice(endings, F.lit(1), F.size(parts) - 1), F.concat(F.lit("b:"), name))


def _index_text(pattern: str) -> str:
    """The longest text that every path with a match of a glob holds; slashes don't count, as some stand for none."""
    plain = re.split(r"[\[{\\]", pattern)[0]
    return max(re.split(r"[*?/]+", plain), key=len)


def ignore_decisions(df: DataFrame, rules: DataFrame, path: str = "path", sources: Sequence[str] | None = None) -> DataFrame:
    """path, decision (include, exclude or null) for each distinct path.

    Each folder and file, once, gets the decision of the last rule that matches it in the highest source rank. A file is excluded with
    any folder above it; else its own decision holds. Rules for a name or an ending are joined by it. Others are looked up by a
    text that they need, all in one pass, and tried where it is held; those without one are constants of the plan.
    """
    table = rules.filter(F.col("source").isin(*sources)) if sources is not None else rules
    rows = table.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise SpecError(f"more than {MOST_RULES} rules")
    paths = df.select(F.col(path).alias("path")).filter("path IS NOT NULL").distinct()
    parts = F.split("path", "/")
    folders = paths.filter(F.size(parts) > 1).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("node"))
    nodes = folders.select("node", F.lit(True).alias("is_dir")).distinct().unionByName(paths.select(F.col("path").alias("node"), F.lit(False).alias("is_dir")))
    keys = ("node", "is_dir")
    indexed, general, looked_up = [], [], []
    for r in rows:
        key = _index_key(r["pattern"]) if r["basename_only"] and not r["anchored"] and not r["case_insensitive"] else None
        scope = r["scope_dir"].strip("/")
        if key:
            indexed.append((key, scope, r["source_rank"], r["seq"], r["decision"], bool(r["dir_only"])))
            continue
        glob = compile_glob(("/" if r["anchored"] else "") + r["pattern"], insensitive=bool(r["case_insensitive"]), slash_anchors=False)
        text = "" if r["case_insensitive"] else _index_text(r["pattern"])
        rule = (r["source_rank"], r["seq"], scope, glob, bool(r["dir_only"]), r["decision"])
        (looked_up.append((text, *rule)) if text else general.append(rule))
    if len(looked_up) <= FEW_RULES:
        general += [r[1:] for r in looked_up]
        looked_up = []
    decision = F.struct("rank", "seq", "decision").alias("d")
    spark, found = df.sparkSession, []
    if indexed:
        known = spark.createDataFrame(indexed, "key string, scope string, rank int, seq int, decision string, dir_only boolean")
        inside = "(scope = '' OR startswith(node, concat(scope, '/'))) AND (NOT dir_only OR is_dir)"
        met = nodes.select(*keys, F.explode(_name_keys(F.element_at(F.split("node", "/"), -1))).alias("key")).join(F.broadcast(known), "key").filter(inside)
        found.append(met.select(*keys, decision))
    if looked_up:
        known = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(looked_up)], "rule long, rank int, seq int, scope string, regex string, dir_only boolean, decision string")
        index = pattern_index.GramIndex([r[0] for r in looked_up], [*range(len(looked_up))])
        met = pattern_index.indexed(nodes.select(*keys), index, "node", "rule").join(F.broadcast(known), "rule")
        below = F.when(F.col("scope") == "", F.col("node")).when(F.expr("startswith(node, concat(scope, '/'))"), F.expr("substring(node, length(scope) + 2)"))
        found.append(met.filter((~F.col("dir_only") | F.col("is_dir")) & F.regexp_like(below, F.col("regex"))).select(*keys, decision))
    general.sort(key=lambda r: r[:2], reverse=True)
    for k in range(0, len(general), RULES_A_PASS):
        tried = [_tried(*r) for r in general[k : k + RULES_A_PASS]]
        found.append(nodes.select(*keys, F.coalesce(*tried).alias("d")).filter("d IS NOT NULL"))
    if not found:
        return paths.select("path", F.lit(None).cast("string").alias("decision"))
    best = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.max("d").alias("d"))
    best = written_once(best.select(*keys, F.col("d.decision").alias("decision")), "ignore-decisions")
    gone = best.filter("is_dir AND decision = 'exclude'").select("node")
    pruned = folders.join(gone, "node").select("path").distinct().withColumn("pruned", F.lit(True))
    own = best.filter("NOT is_dir").select(F.col("node").alias("path"), F.col("decision").alias("own"))
    out = paths.join(own, "path", "left").join(pruned, "path", "left")
    return out.select("path", F.when(F.col("pruned"), "exclude").otherwise(F.col("own")).alias("decision"))


def _tried(rank: int, seq: int, scope: str, regex: str, dir_only: bool, decision: str) -> Column:
    """A rule's rank, seq and decision where it matches a node, else null."""
    below = F.col("node") if not scope else F.when(F.col("node").startswith(f"{scope}/"), F.substring("node", len(scope) + 2, 1 << 30))
    test = below.rlike(regex)
    test = test & F.col("is_dir") if dir_only else test
    return F.when(test, F.struct(F.lit(rank).alias("rank"), F.lit(seq).alias("seq"), F.lit(decision).alias("decision")))


def ignore_filter(df: DataFrame, rules: DataFrame, path: str = "path", sources: Sequence[str] | None = None) -> DataFrame:
    """Files that the rules of the enabled sources (all, by default) don't exclude."""
    gone = ignore_decisions(df, rules, path, sources).filter("decision = 'exclude'").select(F.col("path").alias("__ignored"))
    return df.join(gone, F.col(path) == F.col("__ignored"), "left_anti")


# File types


class FileTypes:
    """A registry of file types; edits make new registries and count before selections, in whatever order they are asked for."""

    def __init__(self, types: dict[str, Sequence[str]] | None = None):
        self.types = {k: tuple(v) for k, v in (FILE_TYPES if types is None else types).items()}

    @classmethod
    def of(cls, frame: DataFrame) -> FileTypes:
        """A registry from a table of name and glob."""
        rows = frame.select("name", "glob").limit(MOST_RULES + 1).collect()
        if len(rows) > MOST_RULES:
            raise SpecError(f"more than {MOST_RULES} globs")
        types: dict[str, list[str]] = {}
        for r in rows:
            types.setdefault(r["name"], []).append(r["glob"])
        return cls(types)

    def add(self, definition: str) -> FileTypes:
        """name:glob, or name:include:other,other."""
        name, _, rest = definition.partition(":")
        if not rest or not name.isalnum():
            raise SpecError(f"not a type definition: {definition}")
        if rest.startswith("include:"):
            globs = [g for other in rest.removeprefix("include:").split(",") for g in self._globs(other)]
        else:
            globs = [rest]
        return FileTypes(self.types | {name: (*self.types.get(name, ()), *globs)})

    def clear(self, name: str) -> FileTypes:
        return FileTypes({k: v for k, v in self.types.items() if k != name})

    def _globs(self, name: str) -> tuple[str, ...]:
        if name not in self.types:
            raise SpecError(f"no file type {name}")
        return self.types[name]

    def frame(self, spark: SparkSession) -> DataFrame:
        """name, glob."""
        rows = [{"name": n, "glob": g} for n, globs in sorted(self.types.items()) for g in globs]
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<name:string,glob:string>>")))

    def matches(self, path: Column, names: Sequence[str]) -> Column:
        """Whether a path is of any of these types; all means every one that is defined."""
        globs = [g for n in names for g in (self._globs(n) if n != "all" else [g for v in self.types.values() for g in v])]
        if not globs:
            return F.lit(False)
        bodies = sorted({compile_glob(g) for g in globs})
        return path.rlike("|".join(f"(?:{b})" for b in bodies))

    def chosen(self, selections: Sequence[tuple[str, str]]) -> tuple[list[str], list[str]]:
        """The names that are selected and those that are negated, by selections ("select" | "negate", name) in order.

        all is every name there is. A selection takes its name, and names for the same globs, out of what was negated
        before; a negation leaves selections as they are."""
        picked: dict[str, None] = {}
        denied: dict[str, None] = {}
        for action, name in selections:
            names = [*self.types] if name == "all" else [n for n in self.types if self.types[n] == self._globs(name)]
            if action == "select":
                picked |= dict.fromkeys(names)
                denied = {n: None for n in denied if n not in names}
            elif action == "negate":
                denied |= dict.fromkeys(names)
            else:
                raise SpecError(f"select or negate, not {action!r}")
        return [*picked], [*denied]


def type_filter(df: DataFrame, types: FileTypes, selections: Sequence[tuple[str, str]], path: str = "path") -> DataFrame:
    """Files of a selected type, if there is any, and of no negated one (see FileTypes.chosen)."""
    picked, denied = types.chosen(selections)
    out = df.filter(types.matches(F.col(path), picked)) if picked else df
    return out.filter(~types.matches(F.col(path), denied)) if denied else out


def tag_types(df: DataFrame, types: FileTypes, path: str = "path") -> DataFrame:
    """The columns of df and type: a row for each type that a path is of."""
    one = lambda name, globs: F.when(F.col(path).rlike("|".join(f"(?:{compile_glob(g)})" for g in globs)), name)
    names = F.array(*(one(name, globs) for name, globs in sorted(types.types.items()) if globs)).cast("array<string>")
    return df.select(*df.columns, F.explode(F.array_compact(names)).alias("type"))


def list_types(spark: SparkSession, types: FileTypes) -> DataFrame:
    """name and globs (sorted, joined by a comma), sorted by name."""
    return types.frame(spark).groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("glob")), ", ").alias("globs")).orderBy("name")


# Limits and reasons


def limit_depth(df: DataFrame, depth: int, path: str = "path") -> DataFrame:
    """Files at most so many components deep; 1 is a root's direct children, 0 only what was named itself (an empty path)."""
    return df.filter(F.when(F.col(path) == "", 0).otherwise(F.size(F.split(F.col(path), "/"))) <= depth)


def limit_size(df: DataFrame, size: int, length: str = "length") -> DataFrame:
    """Files that aren't larger than so many bytes."""
    return df.filter(F.col(length) <= size)


def explain_filters(
    df: DataFrame,
    *,
    path: str = "path",
    globs: Sequence[str] = (),
    show_hidden: bool = False,
    rules: DataFrame | None = None,
    types: FileTypes | None = None,
    selections: Sequence[tuple[str, str]] = (),
    max_depth: int | None = None,
    max_size: int | None = None,
    length: str = "length",
    link: str | None = None,
) -> DataFrame:
    """df with skip_reason: what leaves a file out first (glob, hidden, ignore, type, link, depth, size), or null where it stays.

    link names the column that marks links which weren't followed, as the listing of a tree has it.

    An included override skips the tests for hidden, ignored and typed files. A file that is hidden by its own name alone
    is brought back by a selected type.
    """
    p = F.col(path)
    decision = glob_decision(p, globs) if globs else F.lit(None).cast("string")
    rows = df.withColumn("__glob", decision)
    if rules is not None:
        own = ignore_decisions(df, rules, path).select(F.col("path").alias("__path"), F.col("decision").alias("__ignore"))
        rows = rows.join(own, p == F.col("__path"), "left").drop("__path")
    else:
        rows = rows.withColumn("__ignore", F.lit(None).cast("string"))
    forced = F.coalesce(F.col("__glob") == "include", F.lit(False))
    kept_type, brought_back = F.lit(True), F.coalesce(F.col("__ignore") == "include", F.lit(False))
    if selections:
        picked, denied = types.chosen(selections)
        kept_type = (types.matches(p, picked) if picked else F.lit(True)) & ~(types.matches(p, denied) if denied else F.lit(False))
        brought_back = brought_back | (F.lit(bool(picked)) & kept_type & ~p.rlike(r"(^|/)\.[^/]+/"))
    deep = F.size(F.split(p, "/")) > max_depth if max_depth is not None else F.lit(False)
    large = F.col(length) > max_size if max_size is not None else F.lit(False)
    reason = (
        F.when(F.col("__glob") == "exclude", "glob")
        .when(~forced & F.lit(not show_hidden) & hidden(p) & ~brought_back, "hidden")
        .when(~forced & F.coalesce(F.col("__ignore") == "exclude", F.lit(False)), "ignore")
        .when(~forced & ~kept_type, "type")
        .when(F.coalesce(F.col(link), F.lit(False)) if link else F.lit(False), "link")
        .when(deep, "depth")
        .when(large, "size")
    )
    return rows.withColumn("skip_reason", reason).drop("__glob", "__ignore")
