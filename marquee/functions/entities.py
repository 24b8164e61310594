"""Lists of ``{'id': …, 'name': …}`` records that are kept as text.

The text is either a Python literal or JSON. A few rewrites turn the usual literal into
something ``from_json`` reads, so the work stays in built-in expressions. What it still can't
read is cut into tokens, see ``_from_tokens``, which costs more and is tried for those texts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.lenient import WHITE_SPACE, strip_space, unquoted

# A named entry in the JSON and in the Python spelling.
NAME_PATTERNS = (
    r'"name"\s*:\s*"([^"]+)"',
    r"'name'\s*:\s*'([^']+)'",
)
NAME_KEY = r"""\A["']name["']\s*:\s*"""

_RECORD = "struct<id:string,name:string>"
_JSON = {"allowBackslashEscapingAnyCharacter": "true"}


def _as_json(text: Column) -> Column:
    """The literal in JSON spelling. The rewriting is left out where nothing calls for it."""
    json = text
    for word, literal in (("None", "null"), ("True", "true"), ("False", "false")):
        json = F.regexp_replace(json, rf"""(["']\s*:\s*){word}(?=\s*[,}}])""", rf"$1{literal}")
    json = F.regexp_replace(json, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    json = F.regexp_replace(json, r",\s*\]\s*$", "]")
    odd = F.rtrim(text, F.lit(WHITE_SPACE + "]")).endswith(",")
    for mark in ("None", "True", "False", r"\x"):
        odd = odd | text.contains(mark)
    return F.when(odd, json).otherwise(text)


# Tokens of a literal: texts with their prefix, numbers and words, signs.
_TEXT = r"""[uUrR]?(?:'''(?s:(?:[^\\]|\\.)*?)'''|\"\"\"(?s:(?:[^\\]|\\.)*?)\"\"\"|'(?:[^'\\\n]|\\(?s:.))*+'|"(?:[^"\\\n]|\\(?s:.))*+")"""
_ATOM = r"""[^\s\[\]{}(),:'"]++(?!['"])"""
_TOKEN = rf"{_TEXT}|{_ATOM}|[\[\]{{}}(),:]"
# Pieces of a text: an escape, or what holds none.
_PIECE = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|N\{[^}]+\}|[0-7]{1,3}|(?s:.))|[^\\]+"
# Stands between tokens; no JSON text holds it as it is.
_BETWEEN = "\u0001"
# Escapes of one letter, and what they stand for in JSON.
_SHORT = {"n": r"\n", "t": r"\t", "r": r"\r", "b": r"\b", "f": r"\f", "a": r"\u0007", "v": r"\u000b", "\\": r"\\", "'": "'", '"': r"\"", "\n": ""}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _quoted(plain: Column) -> Column:
    """The text as it stands between the quotes of a JSON text. Most need no change."""
    json = F.to_json(F.array(plain))
    return F.when(plain.rlike(r'["\\\x00-\x1f]'), F.substring(json, F.lit(3), F.length(json) - 4)).otherwise(plain)


def _code_point(point: Column) -> Column:
    """A JSON escape, or two where the code point doesn't fit into one."""

    def unit(number: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.hex(number), 4, "0"))

    above = point - F.lit(0x10000)
    high, low = F.lit(0xD800) + F.shiftright(above, 10), F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))
    return F.when(point < 0x10000, unit(point)).when(point <= 0x10FFFF, F.concat(unit(high), unit(low)))


def _piece(piece: Column) -> Column:
    """A piece of a text in JSON spelling; null for an escape that names no character."""
    second, rest = F.substring(piece, 2, 1), F.substring(piece, F.lit(3), F.length(piece))
    out = F.when(~piece.startswith("\\"), _quoted(piece))
    out = out.when(F.length(piece) > 2, F.when(second.isin("x", "u", "U"), _code_point(F.conv(rest, 16, 10).try_cast("int"))).when(
        second == "N",
        # The name stands in braces.
        _code_point(F.try_reflect(F.lit("java.lang.Character"), F.lit("codePointOf"), F.substring(rest, F.lit(2), F.length(rest) - 2)).try_cast("int")),
    ).otherwise(_code_point(F.conv(F.substring(piece, F.lit(2), F.length(piece)), 8, 10).try_cast("int"))))
    for letter, json in _SHORT.items():
        out = out.when(second == F.lit(letter), F.lit(json))
    out = out.when(second.isin("x", "u", "U", "N"), F.lit(None).cast("string"))
    out = out.when(second.between("0", "7"), _code_point(F.conv(second, 8, 10).try_cast("int")))
    # An escape that means nothing stays as it is.
    return out.otherwise(_quoted(piece))


def _text_token(token: Column) -> Column:
    """A text token as a JSON text; null if one of its escapes names no character."""
    bare = F.regexp_replace(token, r"\A[uUrR]", "")
    ends = F.when(bare.rlike(r"""\A(?:'''|\"\"\")"""), F.lit(3)).otherwise(F.lit(1))
    inner = F.substring(bare, ends + 1, F.length(bare) - F.lit(2) * ends)
    pieces = F.transform(F.regexp_extract_all(inner, F.lit(_PIECE), F.lit(0)), _piece)
    decoded = F.when(~F.exists(pieces, lambda p: p.isNull()), F.array_join(pieces, ""))
    raw_text = token.rlike(r"\A[rR]")
    json = F.when(raw_text | ~inner.contains("\\"), _quoted(inner)).otherwise(decoded)
    return F.concat(F.lit('"'), json, F.lit('"'))


def _json_token(token: Column) -> Column:
    number = F.regexp_replace(token, r"(?<=\d)_(?=\d)|\A\+", "")
    words = {"None": "null", "True": "true", "False": "false"}
    out = F.when(token.isin(*"[]{}(),:"), token).when(token.rlike(r"""['"]\z"""), _text_token(token))
    for word, json in words.items():
        out = out.when(token == word, F.lit(json))
    return out.when(number.rlike(r"\A-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\z"), number)


def _from_tokens(text: Column) -> Column:
    """A literal in JSON spelling, null if it holds something else than lists, tuples, records, texts and numbers.

    Reads prefixes, triple quotes, all escapes, texts that follow each other, tuples, and commas
    before a closing bracket.
    """
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), _json_token)
    nothing_else = F.regexp_replace(text, rf"{_TOKEN}|\s+", "") == ""
    return F.when(nothing_else, _once(tokens, _joined))


def _joined(tokens: Column) -> Column:
    """The tokens as one JSON text, null if one of them has none."""
    joined = F.array_join(tokens, _BETWEEN)
    # Texts that follow each other are one; a comma before a closing bracket goes.
    joined = F.replace(joined, F.lit(f'"{_BETWEEN}"'), F.lit(""))
    # One value in round brackets is that value; with a comma it is a tuple.
    joined = F.regexp_replace(joined, rf"(?<={_BETWEEN})\({_BETWEEN}([^{_BETWEEN}]+){_BETWEEN}\)(?={_BETWEEN})", "$1")
    joined = F.regexp_replace(joined, rf"(?<={_BETWEEN})\((?={_BETWEEN})", "[")
    joined = F.regexp_replace(joined, rf"(?<={_BETWEEN})\)(?={_BETWEEN})", "]")
    joined = F.regexp_replace(joined, rf",{_BETWEEN}(?=[\]}}])", "")
    whole = F.replace(joined, F.lit(_BETWEEN), F.lit(""))
    return F.when(~F.exists(tokens, lambda t: t.isNull()), whole)


def _records_of(json: Column) -> Column:
    records = F.from_json(json, f"array<{_RECORD}>", _JSON)
    # A list that also holds other things than records: keep the records.
    items = F.filter(F.from_json(json, "array<string>", _JSON), lambda item: item.startswith("{"))
    mixed = F.transform(items, lambda item: F.from_json(item, _RECORD, _JSON))
    return F.coalesce(records, mixed)


def read_records(text: Column) -> Column:
    """The records as they stand, ``id`` being text; null where there is no readable list."""
    plain = strip_space(text)
    is_list = plain.startswith("[") & plain.endswith("]")
    # Escapes that mean something else in JSON, or nothing.
    escaped = text.contains("\\") & text.rlike(r"""(?<!\\)(?:\\\\)*\\[^\\'"ntrbfxu]""")
    usual = F.when(~escaped, _records_of(_as_json(text)))
    return F.when(is_list, F.coalesce(usual, _once(_from_tokens(text), _records_of)))


def entities(records: Column, named_only: bool = True) -> Column:
    """``array<struct<id:bigint,name:string,ref:string>>`` of the records, empty for null.

    ``named_only`` drops records without a name; without it every record counts. ``ref`` is
    the text of an id that isn't a whole number, so that such entities can be told apart.
    """
    present = F.filter(records, lambda r: (F.coalesce(r["name"], F.lit("")) != "") if named_only else r.isNotNull())
    typed = F.transform(
        present,
        lambda r: F.struct(
            r["id"].try_cast("bigint").alias("id"),
            r["name"].alias("name"),
            F.when(r["id"].try_cast("bigint").isNull(), r["id"]).alias("ref"),
        ),
    )
    return F.coalesce(typed, F.array().cast("array<struct<id:bigint,name:string,ref:string>>"))


def as_records(typed: Column) -> Column:
    """The records as they were read, with one id."""
    return F.transform(
        typed, lambda e: F.struct(F.coalesce(e["id"].cast("string"), e["ref"]).alias("id"), e["name"].alias("name"))
    )


def status(text: Column, records: Column) -> Column:
    """``ok``, ``empty`` (nothing was stated) or ``unreadable`` (goes to quarantine)."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(F.lower(plain).isin("", "nan", "false", "none", "null"), F.lit("empty"))
        .when(records.isNull(), F.lit("unreadable"))
        .otherwise(F.lit("ok"))
    )


def parse_entities(text: Column, named_only: bool = True) -> Column:
    return entities(read_records(text), named_only)


def entities_status(text: Column) -> Column:
    return status(text, read_records(text))


def lead_by_pattern(text: Column) -> Column:
    """The first name found by the two patterns alone, the double-quoted ones first; null if there is none."""
    pairs = [F.nullif(F.regexp_extract(text, pattern, 0), F.lit("")) for pattern in NAME_PATTERNS]
    return unquoted(F.regexp_replace(F.coalesce(*pairs), NAME_KEY, ""))


def names_by_pattern(text: Column) -> Column:
    """Names found by the two patterns alone; quotes inside a name are not understood."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) for pattern in NAME_PATTERNS]
    return F.coalesce(F.concat(*found), F.array().cast("array<string>"))
