"""The dialect and the policies of reading and writing, checked once."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: The code points that count as white space.
_SPACE_POINTS = (*range(0x0009, 0x000E), 0x0020, 0x0085, 0x00A0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WHITESPACE = "".join(map(chr, _SPACE_POINTS))
#: The same as a regular expression's class, and without the characters of row endings.
SPACE_CLASS = "[" + "".join(f"\\x{{{c:X}}}" for c in _SPACE_POINTS) + "]"
BLANK_CLASS = "[" + "".join(f"\\x{{{c:X}}}" for c in _SPACE_POINTS if c not in (10, 13)) + "]"
ENDINGS = {"LF": "\n", "CR": "\r", "CRLF": "\r\n"}


class OptionsError(ValueError):
    """A combination of settings that has no meaning."""


@dataclass(frozen=True)
class Options:
    """Sixteen settings. ``schema_provider`` is a schema, or a function that makes one, for plans that are given none; the last four have no effect
    here (Spark owns memory and row lifetimes) but may be given."""

    separator: str = ","
    quote: str | None = '"'
    escape: str | None = '"'
    read_ending: str = "DETECT"
    write_ending: str = "CRLF"
    read_header: str = "DETECT"
    write_header: str = "ALWAYS"
    write_trailing_ending: str = "NEVER"
    comment: str | None = None
    trim_leading_in: bool = False
    trim_trailing_in: bool = False
    trim_before: bool = False
    trim_after: bool = False
    extra_columns: str = "IGNORE"
    schema_provider: object | None = None
    memory_pool: object | None = None
    read_buffer_hint: int = 0
    write_buffer_hint: int | None = None
    row_disposal: str = "ON_READER_DISPOSE"

    def __post_init__(self) -> None:
        def need(ok: bool, message: str) -> None:
            if not ok:
                raise OptionsError(message)

        for value, allowed in (
            (self.read_ending, (*ENDINGS, "DETECT")), (self.write_ending, tuple(ENDINGS)), (self.read_header, ("ALWAYS", "NEVER", "DETECT")),
            (self.write_header, ("ALWAYS", "NEVER")), (self.write_trailing_ending, ("ALWAYS", "NEVER")), (self.extra_columns, ("IGNORE", "INCLUDE_DYNAMIC", "THROW")),
            (self.row_disposal, ("ON_READER_DISPOSE", "ON_EXPLICIT_DISPOSE")),
        ):
            need(value in allowed, f"{value!r} is not one of {allowed}")
        need(bool(self.separator), "the separator is empty")
        for c in (self.quote, self.escape, self.comment):
            need(c is None or len(c) == 1, "quote, escape and comment are single characters")
        first = self.separator[0]
        need(first != self.quote, "the separator starts with the quote")
        need(first != self.comment, "the separator starts with the comment character")
        need(self.comment is None or self.comment != self.quote, "quote and comment character are the same")
        need(self.escape is None or self.quote is not None, "an escape character needs a quote")
        need(self.separator not in ENDINGS.values() and self.separator != ENDINGS.get(self.read_ending), "the separator is a row ending")
        need(self.read_buffer_hint >= 0 and (self.write_buffer_hint or 0) >= 0, "buffer hints are not negative")
        if self.trims:
            for c in (first, self.quote, self.escape, self.comment):
                need(c is None or c not in WHITESPACE, "with trimming, no special character may be white space")

    @property
    def trims(self) -> bool:
        return self.trim_leading_in or self.trim_trailing_in or self.trim_before or self.trim_after

    def but(self, **changes) -> Options:
        return replace(self, **changes)


DEFAULT = Options()
DYNAMIC_DEFAULT = Options(read_header="ALWAYS", extra_columns="INCLUDE_DYNAMIC")
