"""From search patterns to Java regular expressions, while a plan is built.

Patterns are in the usual automaton-style dialect: Unicode classes by default, $ as the true end, POSIX classes,
(?P<name>...). Java's own extras (look-around, back-references, atomic and possessive forms, \\Q..\\E) pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from trawl.spec import SearchSpec, SpecError

# The POSIX classes as ASCII ranges for the inside of a bracket.
POSIX = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}

#: Characters that are more than themselves in a pattern.
META = set(r"\.+*?()|[]{}^$#&-~")
#: Texts that a part of a pattern may stand for.
MOST_FORMS = 8
WORD_CHARS = r"[\p{L}\p{M}\p{N}_]"
_CATEGORY = re.compile(r"L[ultmoC]?|M[nce]?|N[dlo]?|P[cdseifo]?|S[mcko]?|Z[slp]?|C[cfson]?|LC")
_LONG = {"letter": "L", "mark": "M", "number": "N", "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C", "uppercase": "IsUppercase", "lowercase": "IsLowercase", "alphabetic": "IsAlphabetic", "white_space": "IsWhite_Space"}


@dataclass(frozen=True)
class Compiled:
    """regex: for Java, with flags. literals: where the search is for plain texts alone. groups: names to numbers. required: a text that every match holds."""

    regex: str
    literals: tuple[str, ...] | None
    groups: dict[str, int]
    n_groups: int
    required: str | None


class _Translation:
    """One pass over a pattern, with a stack of the multi-line flag for groups."""

    def __init__(self, pattern: str, spec: SearchSpec, first_group: int):
        self.p, self.spec, self.at, self.n = pattern, spec, 0, first_group
        self.groups: dict[str, int] = {}
        self.multi = [spec.multiline or spec.null_data]
        self.unicode = spec.unicode

    def run(self) -> str:
        out = []
        while self.at < len(self.p):
            out.append(self._next())
        return "".join(out)

    def _next(self) -> str:
        p, c = self.p, self.p[self.at]
        if c == "\\":
            return self._escape(False)
        if c == "[":
            return self._bracket()
        if c == "(":
            return self._group()
        self.at += 1
        if c == ")":
            if len(self.multi) > 1:
                self.multi.pop()
            return c
        if c == "$":
            return self._end()
        if c == "^":
            return r"(?:(?<=\n)|(?<=\r)(?!\n)|\A)" if self.multi[-1] and self.spec.crlf else "^"
        if c == "{":
            m = re.compile(r"(\d*)(,?)(\d*)\}").match(p, self.at)
            if m and (m[1] or (m[2] and m[3])):
                self.at = m.end()
                return "{" + (m[1] or "0") + m[2] + m[3] + "}"
            return r"\{"
        return c

    def _end(self) -> str:
        if self.multi[-1]:
            return r"(?:(?=\r?\n|\z)(?<!\r(?=\n))|(?=\r))" if self.spec.crlf else "$"
        return r"(?=\r?\z)" if self.spec.crlf else r"\z"

    def _escape(self, inside: bool) -> str:
        p, start = self.p, self.at
        if start + 1 >= len(p):
            raise SpecError("a pattern can't end in a backslash")
        c = p[start + 1]
        self.at = start + 2
        if c == "Q" and not inside:
            end = p.find(r"\E", self.at)
            body, self.at = (p[self.at :], len(p)) if end < 0 else (p[self.at : end], end + 2)
            return re.sub(r"[^\w\s]|_", lambda m: "\\" + m[0] if m[0].isascii() and m[0] != "_" else m[0], body)
        if c in "pP":
            return self._property(c, inside)
        if c in "xuU" and p[self.at : self.at + 1] == "{":
            end = p.index("}", self.at)
            digits, self.at = p[self.at + 1 : end], end + 1
            return rf"\x{{{digits}}}"
        if c == "U" and re.fullmatch(r"[0-9A-Fa-f]{8}", p[self.at : self.at + 8]):
            digits, self.at = p[self.at : self.at + 8], self.at + 8
            return rf"\x{{{int(digits, 16):x}}}"
        if c == "v":
            return r"\x0B"
        if c == "k" and not inside:
            m = re.compile(r"<(\w+)>|\{(\w+)\}|'(\w+)'").match(p, self.at)
            if m:
                self.at = m.end()
                return self._back(m[m.lastindex])
        if c == "b" and not inside and p[self.at : self.at + 1] == "{":
            end = p.index("}", self.at)
            name, self.at = p[self.at + 1 : end], end + 1
            sides = {"start": r"(?<!\w)(?=\w)", "end": r"(?<=\w)(?!\w)", "start-half": r"(?<!\w)", "end-half": r"(?!\w)"}
            if name not in sides:
                raise SpecError(f"unknown boundary {name}")
            return sides[name]
        if c == "<" and not inside:
            return r"(?<!\w)(?=\w)"
        if c == ">" and not inside:
            return r"(?<=\w)(?!\w)"
        if c == "Z" and not inside:
            return r"\z"
        return "\\" + c

    def _back(self, name: str) -> str:
        if name not in self.groups:
            raise SpecError(f"no group {name}")
        return rf"\{self.groups[name]}(?:)"

    def _property(self, kind: str, inside: bool) -> str:
        p = self.p
        if p[self.at : self.at + 1] == "{":
            end = p.index("}", self.at)
            name, self.at = p[self.at + 1 : end], end + 1
        else:
            name, self.at = p[self.at : self.at + 1], self.at + 1
        if not self.unicode:
            raise SpecError("Unicode classes need unicode=True")
        if name.startswith("^"):
            kind, name = "pP".replace(kind, ""), name[1:]
        name = re.sub(r"^(gc|general_category|sc|script|scx)\s*[=:]\s*", "", name, flags=re.I)
        if name.lower() in ("any", "assigned"):
            body = r"\s\S" if name.lower() == "any" else r"\P{Cn}"
            return (body if inside else f"[{body}]") if kind == "p" else "[^" + body + "]"
        known = _LONG.get(name.lower().replace(" ", "_"))
        if known or _CATEGORY.fullmatch(name):
            return rf"\{kind}{{{known or name}}}"
        return rf"\{kind}{{Is{name.replace(' ', '_')}}}"

    def _bracket(self) -> str:
        p = self.p
        self.at += 1
        out = ["["]
        if p[self.at : self.at + 1] == "^":
            out.append("^")
            self.at += 1
        if p[self.at : self.at + 1] == "]":
            out.append(r"\]")
            self.at += 1
        while True:
            if self.at >= len(p):
                raise SpecError("a bracket isn't closed")
            c = p[self.at]
            if c == "]":
                self.at += 1
                return "".join(out) + "]"
            if c == "\\":
                out.append(self._escape(True))
            elif c == "[":
                m = re.compile(r"\[:(\^?)(\w+):\]").match(p, self.at)
                if m:
                    if m[2] not in POSIX:
                        raise SpecError(f"unknown class {m[2]}")
                    self.at = m.end()
                    out.append(f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]])
                else:
                    out.append(self._bracket())
            elif p.startswith("--", self.at) and len(out) > 1 and p[self.at + 2 : self.at + 3] == "[":
                self.at += 2
                out.append("&&[^" + self._bracket() + "]")
            else:
                self.at += 1
                out.append(c)

    def _group(self) -> str:
        p = self.p
        m = re.compile(r"\(\?P?<(\w+)>").match(p, self.at)
        if m:
            self.at = m.end()
            self.n += 1
            if m[1] in self.groups:
                raise SpecError(f"two groups named {m[1]}")
            self.groups[m[1]] = self.n
            self.multi.append(self.multi[-1])
            return "("
        m = re.compile(r"\(\?P=(\w+)\)").match(p, self.at)
        if m:
            self.at = m.end()
            return self._back(m[1])
        m = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])").match(p, self.at)
        if m:
            self.at = m.end()
            on, off = m[1], m[2] or ""
            if "U" in on + off:
                raise SpecError("swapped greediness isn't supported")
            if "u" in off and re.search(r"\\[pP]", p[self.at :]):
                raise SpecError("Unicode classes need unicode=True")
            on = "".join({"u": "U", "R": "", "i": "iu" if self.unicode else "i"}.get(f, f) for f in on)
            off = "".join({"u": "U", "R": ""}.get(f, f) for f in off)
            multi = "m" in m[1] or (self.multi[-1] and "m" not in off)
            if m[3] == ":":
                self.multi.append(multi)
            else:
                self.multi[-1] = multi
            flags = on + ("-" + off if off else "")
            return f"(?{flags}{m[3]}" if flags or m[3] == ":" else ""
        self.at += 1
        self.multi.append(self.multi[-1])
        if p[self.at : self.at + 1] != "?" and p[self.at : self.at + 1] != "*":
            self.n += 1
        return "("


def _is_literal(pattern: str) -> bool:
    return not any(c in META for c in pattern.replace("-", "").replace("#", "").replace("&", "").replace("~", ""))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.+*?()|[]{}^$#&-~" else c for c in text)


def ignores_case(spec: SearchSpec) -> bool:
    """Smart case looks at the letters of a pattern, not at escapes such as \\S."""
    if spec.case != "smart":
        return spec.case == "ignore"
    bare = [p if spec.fixed else re.sub(r"\\[pPxuU]\{[^}]*\}|\\.|\(\?P?<\w+>", "", p, flags=re.DOTALL) for p in spec.patterns]
    return not any(c.isupper() for p in bare for c in p)


def required_literal(pattern: str) -> str | None:
    """The longest run of three or more plain characters that every match of a single-branch pattern holds."""
    if re.search(r"[|(\[]|\\[QpPxuUk\d]|\(\?", pattern):
        return None
    runs, run, k = [], "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            nxt = pattern[k + 1 : k + 2]
            plain = nxt if nxt and not nxt.isalnum() and nxt not in "<>" else None
            k += 2
        else:
            plain = None if c in META - set("-#&~") else c
            k += 1
        if pattern[k : k + 1] in ("?", "*", "{"):
            plain = None
        if plain is None:
            runs.append(run)
            run = ""
        else:
            run += plain
            if pattern[k : k + 1] == "+":
                runs.append(run)
                run = ""
    best = max([*runs, run], key=len)
    return best if len(best) >= 3 else None


def in_order(spec: SearchSpec) -> list[tuple[str, ...]] | None:
    """The parts of a single pattern made of plain characters, some of which may be missing (x?), and of .* between parts: a line
    matches where it holds a text of each part, one behind the other. None for other searches, or with more than MOST_FORMS texts of a part.
    """
    if len(spec.patterns) != 1 or spec.fixed or ignores_case(spec) or spec.boundary or spec.multiline or spec.null_data:
        return None
    pattern, parts, forms, k = spec.patterns[0], [], [""], 0
    repeated = lambda at: pattern[at : at + 1] in set("?+*{")
    while k < len(pattern):
        c, k = pattern[k], k + 1
        if c == "." and pattern[k : k + 1] == "*" and not repeated(k + 1):
            parts, forms, k = [*parts, forms], [""], k + 1
            continue
        if c == "\\" and pattern[k : k + 1] in META:
            c, k = pattern[k], k + 1
        elif c in META - set("-#&~"):
            return None
        missing = pattern[k : k + 1] == "?"
        if repeated(k + missing):
            return None
        forms, k = [f + t for f in forms for t in ((c, "") if missing else (c,))], k + missing
        if len(forms) > MOST_FORMS:
            return None
    # A part that may be empty stands everywhere.
    return [tuple(dict.fromkeys(p)) for p in [*parts, forms] if "" not in p]


def ordered(parts: list[tuple[str, ...]]) -> str:
    """A regular expression for parts as in_order has them."""
    return "(?s)" + ".*".join(f"(?:{'|'.join(map(_quoted, texts))})" for texts in parts)


def compile_patterns(spec: SearchSpec) -> Compiled:
    """All patterns of a search as one leftmost-first alternation."""
    insensitive = ignores_case(spec)
    plain = spec.fixed or all(_is_literal(p) for p in spec.patterns)
    literals = None
    if not insensitive and spec.boundary is None and not spec.multiline and spec.patterns:
        if plain:
            literals = spec.patterns
        elif len(spec.patterns) == 1 and all(_is_literal(b) for b in spec.patterns[0].split("|")):
            literals = tuple(spec.patterns[0].split("|"))
    groups, n, parts = {}, 0, []
    for p in spec.patterns:
        if spec.fixed:
            parts.append(_quoted(p))
        else:
            t = _Translation(p, spec, n)
            parts.append(t.run())
            groups |= t.groups
            n = t.n
    body = "|".join(f"(?:{p})" for p in parts) if len(parts) > 1 else "".join(parts)
    multi = spec.multiline or spec.null_data
    if spec.boundary == "word":
        around = WORD_CHARS if spec.unicode else "[0-9A-Za-z_]"
        body = f"(?<!{around})(?:{body})(?!{around})"
    elif spec.boundary == "line":
        end = "$" if multi else r"(?=\r?\z)" if spec.crlf else r"\z"
        body = f"^(?:{body}){end}"
    flags = "d" + ("U" if spec.unicode else "") + ("i" + "u" * spec.unicode if insensitive else "") + "m" * multi + "s" * spec.dotall
    required = None
    if len(spec.patterns) == 1 and not insensitive:
        required = spec.patterns[0] if spec.fixed else required_literal(spec.patterns[0])
    return Compiled(f"(?{flags}){body}", literals, groups, n, required or None)


def compile_template(template: str, compiled: Compiled) -> str:
    """A replacement in Java's syntax: the longest name wins, an unknown group is nothing, $$ is a dollar."""

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        name = m[1] or m[2]
        if name is None:
            return r"\$"
        if name in compiled.groups:
            k = compiled.groups[name]
        elif name.isdigit() and int(name) <= compiled.n_groups:
            k = int(name)
        else:
            return ""
        return f"${{{k}}}"

    out, at = [], 0
    for m in re.finditer(r"\$\$|\$\{([^}]*)\}|\$(\w+)|\$", template):
        out.append(template[at : m.start()].replace("\\", r"\\"))
        piece = one(m)
        if piece.startswith("${"):
            k = piece[2:-1]
            # A digit that follows would be read as part of the number; an escape keeps it apart.
            rest = template[m.end() : m.end() + 1]
            piece = f"${k}" if not rest.isdigit() else f"${k}\\{rest}"
            out.append(piece)
            at = m.end() + (1 if rest.isdigit() else 0)
            continue
        out.append(piece)
        at = m.end()
    out.append(template[at:].replace("\\", r"\\"))
    return "".join(out)
