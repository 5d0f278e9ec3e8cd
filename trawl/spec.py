"""What to search for, as one validated record."""

from __future__ import annotations

from dataclasses import dataclass, replace


class SpecError(ValueError):
    """A search that can't be planned."""


@dataclass(frozen=True)
class SearchSpec:
    """A search over the lines (or, multi-line, the whole texts) of documents.

    patterns: none match nothing, an empty one matches everything. case: sensitive, ignore or smart (insensitive
    unless a pattern has an upper-case letter). boundary: None, word or line. template: replacement with $n, $name,
    ${name} and $$. Numbers of context lines, and of matching lines that are kept in a document, are per document.
    raw: texts are bytes, a character each, as files.decoded() gives them with encoding none.
    """

    patterns: tuple[str, ...] = ()
    fixed: bool = False
    case: str = "sensitive"
    boundary: str | None = None
    invert: bool = False
    unicode: bool = True
    crlf: bool = False
    null_data: bool = False
    multiline: bool = False
    dotall: bool = False
    before: int = 0
    after: int = 0
    passthru: bool = False
    max_count: int | None = None
    stop_on_nonmatch: bool = False
    template: str | None = None
    trim: bool = False
    max_columns: int | None = None
    max_columns_preview: bool = False
    raw: bool = False

    def __post_init__(self):
        if isinstance(self.patterns, str):
            object.__setattr__(self, "patterns", (self.patterns,))
        object.__setattr__(self, "patterns", tuple(self.patterns))
        if self.case not in ("sensitive", "ignore", "smart"):
            raise SpecError(f"case is sensitive, ignore or smart, not {self.case!r}")
        if self.boundary not in (None, "word", "line"):
            raise SpecError(f"boundary is None, 'word' or 'line', not {self.boundary!r}")
        if min(self.before, self.after) < 0 or (self.max_count or 0) < 0 or (self.max_columns or 0) < 0:
            raise SpecError("counts can't be negative")
        if self.crlf and self.null_data:
            raise SpecError("crlf and null_data exclude each other")
        if self.dotall and not self.multiline:
            raise SpecError("dotall needs multiline")
        if self.passthru and (self.before or self.after):
            raise SpecError("passthru shows every line and takes no context")

    def but(self, **changes) -> SearchSpec:
        return replace(self, **changes)

    @property
    def separator(self) -> str:
        return "\0" if self.null_data else "\n"


def spec(*patterns: str, **options) -> SearchSpec:
    """SearchSpec with the patterns as arguments."""
    return SearchSpec(patterns, **options)
