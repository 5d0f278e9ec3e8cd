"""From path globs to anchored regular expressions, while a plan is built."""

from __future__ import annotations

import re

from trawl.spec import SpecError


def glob_body(glob: str) -> str:
    """A glob as a regular expression: * and ? keep to a component, ** does not, [..] and {a,b} as in shells."""
    out, at, depth = [], 0, 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at) and (at == 0 or glob[at - 1] == "/"):
            out.append("(?:[^/]+/)*")
            at += 3
        elif glob.startswith("/**", at) and at + 3 == len(glob):
            out.append("/.*")
            at += 3
        elif glob.startswith("**", at):
            out.append(".*")
            at += 2
        elif c == "*":
            out.append("[^/]*")
            at += 1
        elif c == "?":
            out.append("[^/]")
            at += 1
        elif c == "[":
            end = glob.find("]", at + 2 + (glob[at + 1 : at + 2] in ("!", "^")))
            if end < 0:
                raise SpecError(f"a bracket isn't closed: {glob}")
            body = glob[at + 1 : end]
            negated = body[:1] in ("!", "^")
            body = body[negated:].replace("\\", r"\\").replace("[", r"\[").replace("]", r"\]").replace("^", r"\^").replace("&", r"\&")
            out.append(f"[^/{body}]" if negated else f"[{body}]")
            at = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
            at += 1
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
            at += 1
        elif c == "," and depth:
            out.append("|")
            at += 1
        elif c == "\\" and at + 1 < len(glob):
            out.append(re.escape(glob[at + 1]))
            at += 2
        else:
            out.append(re.escape(c))
            at += 1
    if depth:
        raise SpecError(f"a brace isn't closed: {glob}")
    return "".join(out)


def compile_glob(glob: str, *, insensitive: bool = False, slash_anchors: bool = True) -> str:
    """The anchored expression of a glob for whole relative paths.

    Without a slash it is for the last component; a leading slash anchors at the root; with a slash inside it is for
    paths from the root, or, where slash_anchors is false (ignore rules), at any depth.
    """
    anchored = glob.startswith("/")
    body = glob[1:] if anchored else glob
    prefix = "" if anchored or (slash_anchors and "/" in body.rstrip("/")) else "(?:.*/)?"
    return ("(?is)" if insensitive else "(?s)") + "^" + prefix + glob_body(body.rstrip("/") if body != "/" else body) + "$"
