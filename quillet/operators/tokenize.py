"""Delimited text to records and values, as regular expressions that Catalyst evaluates.

A dialect is a regular language, so a record is one match and a value is one match inside it. All quantifiers are possessive: no
backtracking, whatever the text. What the expressions do not cover is malformed; ``strict`` says how.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet.options import BLANK_CLASS, ENDINGS, SPACE_CLASS, Options

_ENDING = {"LF": r"\n", "CR": r"\r", "CRLF": r"\r\n"}


def _one(c: str) -> str:
    return f"\\x{{{ord(c):X}}}"


def _text(s: str) -> str:
    return "".join(map(_one, s))


def _quoted(o: Options) -> str:
    if o.quote is None:
        return "(?!)"
    q = _one(o.quote)
    if o.escape is None:
        return f"{q}[^{q}]*+{q}"
    e = _one(o.escape)
    if o.escape == o.quote:
        return f"{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}"
    return f"{q}[^{q}{e}]*+(?:{e}[{q}{e}][^{q}{e}]*+)*+{q}"


def _value(o: Options, ending: str) -> str:
    """A value with the white space outside it that the dialect skips."""
    stop = {"LF": r"\n", "CR": r"\r", "CRLF": r"\r"}[ending] + (_one(o.quote) if o.quote else "")
    plain = f"[^{stop}{_one(o.separator)}]*+" if len(o.separator) == 1 else f"(?:(?!{_text(o.separator)})[^{stop}])*+"
    before, after = f"{BLANK_CLASS}*+" if o.trim_before else "", f"{BLANK_CLASS}*+" if o.trim_after else ""
    return f"(?:{before}(?:{_quoted(o)}{after}|{plain}))"


def record_pattern(o: Options, ending: str) -> str:
    """One record or comment with its ending; a record doesn't start with a row ending's character that isn't the dialect's."""
    end = f"(?:{_ENDING[ending]}|\\z)"
    value = _value(o, ending)
    skip = f"{BLANK_CLASS}*+" if o.trim_before else ""
    no_start = f"(?!{skip}{chr(92)}{'r' if ending == 'LF' else 'n'})"
    row = f"{no_start}{value}(?:{_text(o.separator)}{value})*+"
    if o.comment is None:
        return f"\\G(?!\\z){row}{end}"
    inside = {"LF": r"[^\n]*+", "CR": r"[^\r]*+", "CRLF": r"(?:[^\r]|\r(?!\n))*+"}[ending]
    return f"\\G(?!\\z)(?:{skip}{_one(o.comment)}{inside}|(?!{skip}{_one(o.comment)}){row}){end}"


def detect_ending(text: Column, o: Options) -> Column:
    """LF, CR or CRLF: the first row ending outside quotes; CRLF if there is none."""
    bare = text
    if o.quote is not None:
        bare = F.regexp_replace(text, _quoted(o) if o.escape is None or o.escape != o.quote else f"{_one(o.quote)}[^{_one(o.quote)}]*+(?:{_one(o.quote)}|\\z)", "")
    first = F.regexp_extract(bare, r"(\r\n|\r|\n)", 1)
    return F.when(first == "\n", "LF").when(first == "\r", "CR").otherwise("CRLF")


def _trimmed(v: Column, start: bool, end: bool) -> Column:
    v = F.regexp_replace(v, f"^{SPACE_CLASS}++", "") if start else v
    return F.regexp_replace(v, f"{SPACE_CLASS}++\\z", "") if end else v


def _content(raw: Column, o: Options) -> tuple[Column, Column]:
    """(whether it is quoted, the text inside) of a raw value, before trimming inside it."""
    skipped = F.regexp_replace(raw, f"^{BLANK_CLASS}++", "") if o.trim_before else raw
    if o.quote is None:
        return F.lit(False), skipped
    quoted = skipped.startswith(F.lit(o.quote))
    bare = F.regexp_replace(skipped, f"{BLANK_CLASS}++\\z", "") if o.trim_after else skipped
    inside = F.substring(bare, F.lit(2), F.greatest(F.char_length(bare) - 2, F.lit(0)))
    if o.escape == o.quote:
        inside = F.replace(inside, F.lit(o.quote * 2), F.lit(o.quote))
    elif o.escape is not None:
        inside = F.regexp_replace(inside, f"{_one(o.escape)}(.)", "$1")
    return quoted, F.when(quoted, inside).otherwise(skipped)


def by_ending(make, ending: str | Column) -> Column:
    """What ``make`` gives for a known ending, as a literal; for an ending in a column, the choice among the three."""
    if isinstance(ending, str):
        return F.lit(make(ending))
    return F.when(ending == "LF", make("LF")).when(ending == "CR", make("CR")).otherwise(make("CRLF"))


def ending_of(text: Column, o: Options) -> str | Column:
    """The dialect's ending, or the one that is found in the text."""
    return o.read_ending if o.read_ending != "DETECT" else detect_ending(text, o)


def found_records(text: Column, o: Options, ending: str | Column) -> Column:
    """array<string> of a text's records and comments with their endings, up to where it is malformed."""
    return F.regexp_extract_all(text, by_ending(lambda e: record_pattern(o, e), ending), 0)


def checked_records(found: Column, text: Column, o: Options) -> Column:
    """The records found, if they are the whole text; else an error."""
    covered = F.char_length(F.array_join(found, ""))
    checked = F.when(covered == F.char_length(text), found).otherwise(F.raise_error(F.concat(F.lit("malformed delimited text after character "), covered.cast("string"))))
    if o.trim_before:  # nothing but skipped white space at the end of the data is no record
        last = F.try_element_at(checked, F.lit(-1))
        checked = F.when(last.rlike(f"^{BLANK_CLASS}++\\z"), F.slice(checked, F.lit(1), F.size(checked) - 1)).otherwise(checked)
    return checked


def is_comment(record: Column, o: Options) -> Column:
    if o.comment is None:
        return F.lit(False)
    return record.rlike(f"^{BLANK_CLASS + '*+' if o.trim_before else ''}{_one(o.comment)}")


def comment_text(record: Column, o: Options, ending: str | Column) -> Column:
    """A comment without its character and its ending."""
    skip = f"{BLANK_CLASS}*+" if o.trim_before else ""
    return F.regexp_replace(record, by_ending(lambda e: f"^{skip}{_one(o.comment)}|{_ENDING[e]}\\z", ending), F.lit(""))


def raw_values(record: Column, o: Options, ending: str | Column) -> Column:
    """array<string> of a record's values as they stand in the text.

    A last value without characters is absent, not empty; quoted, it is kept only at the end of the data, where quote and escape are one.
    """
    sep = _text(o.separator)
    # values that have no characters though they stand in the text, where an ending follows and where none does
    blank = [f"{BLANK_CLASS}++"] if o.trim_before else []
    quoted = [] if o.quote is None else [f"{BLANK_CLASS + '*+' if o.trim_before else ''}{_one(o.quote) * 2}"]
    after = f"{BLANK_CLASS}*+" if o.trim_after else ""
    none = "|".join([*(q + after for q in quoted), *blank]) or "(?!)"
    kept = o.quote is not None and o.quote == o.escape
    none_at_end = "|".join([*(q + after.replace("*+", "++") for q in quoted if after or not kept), *([] if kept else quoted), *blank]) or "(?!)"
    body = F.regexp_replace(record, by_ending(lambda e: f"(?:(^|{sep})(?:{none}))?{_ENDING[e]}\\z|(^|{sep})(?:{none_at_end})\\z", ending), F.lit("$1$2"))
    # an empty value after a last separator is absent too: no match starts at the end
    return F.regexp_extract_all(body, by_ending(lambda e: f"\\G(?!\\z)({_value(o, e)})(?:{sep}|\\z)", ending), 1)


def value_of(raw: Column, o: Options) -> Column:
    """The value that a raw value stands for."""
    quoted, text = _content(raw, o)
    plain = _trimmed(text, o.trim_leading_in, o.trim_trailing_in or o.trim_after)
    return F.when(quoted, _trimmed(text, o.trim_leading_in, o.trim_trailing_in)).otherwise(plain)


def values(raws: Column, o: Options) -> Column:
    """Raw values as values. Where none is quoted and nothing is trimmed, they are what they stand for."""
    made = F.transform(raws, lambda r: value_of(r, o))
    if o.trims:
        return made
    return raws if o.quote is None else F.when(F.array_join(raws, "").contains(F.lit(o.quote)), made).otherwise(raws)


def records(text: Column, o: Options) -> Column:
    """array<struct<kind, values, comment>> of a whole text; malformed text is an error.

    For a few records at a time; the readers take them apart row by row.
    """

    def of(ending: str) -> Column:
        def one(r: Column) -> Column:
            row = values(raw_values(r, o, ending), o)
            if o.comment is None:
                return F.struct(F.lit("row").alias("kind"), row.alias("values"), F.lit(None).cast("string").alias("comment"))
            comment = is_comment(r, o)
            return F.struct(F.when(comment, "comment").otherwise("row").alias("kind"), F.when(~comment, row).alias("values"), F.when(comment, comment_text(r, o, ending)).alias("comment"))

        return F.transform(checked_records(found_records(text, o, ending), text, o), one)

    if o.read_ending != "DETECT":
        return of(o.read_ending)
    # chosen outside: inside, the ending would be looked for again for each record
    found = detect_ending(text, o)
    return F.when(found == "LF", of("LF")).when(found == "CR", of("CR")).otherwise(of("CRLF"))


def well_formed(text: Column, o: Options) -> Column:
    """Whether ``records`` covers all of the text."""
    return F.char_length(F.array_join(found_records(text, o, ending_of(text, o)), "")) == F.char_length(text)


def is_header(row: Column, names: list[str], o: Options) -> Column:
    """Whether a text's first row is a header of these columns, under the read policy."""
    if o.read_header == "NEVER":
        return F.lit(False)
    any_name = F.coalesce(F.arrays_overlap(row, F.array(*map(F.lit, names))), F.lit(False)) if names else F.lit(False)
    if o.read_header == "DETECT":
        return any_name
    # a fixed message
    return F.when(any_name, True).otherwise(F.raise_error(F.lit("First row of input was not a row of headers")))


