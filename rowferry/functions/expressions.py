"""Configuration expressions with the meaning their writers expect.

Expressions are Spark SQL text. A few names mean something else in MySQL, for which the
configurations are written; ``spark_text`` renames those and leaves the rest to Spark:

* ``LENGTH`` counts bytes; ``CAST`` and ``DATE`` give NULL for a bad value; ``CHAR(n)`` cuts;
* ``DATE_FORMAT`` and ``STR_TO_DATE`` take ``%Y-%m-%d`` patterns; ``%y`` reads 70 to 99 as 1970 to 1999;
* ``SUBSTRING`` from 0, or from before the first character, is empty;
* ``/`` and ``%`` give NULL for a zero divisor.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# MySQL pattern codes and the Spark letters for printing them.
PRINT_CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H",
    "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a",
    "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss",
}
# Reading accepts one or two digits.
READ_CODES = {**PRINT_CODES, "m": "M", "d": "d", "H": "H", "h": "h", "I": "h", "i": "m", "s": "s",
              "S": "s", "T": "H:m:s"}
TIME_CODES = frozenset("HkhIlisSfpT")
CAST_TYPES = {"SIGNED": "bigint", "UNSIGNED": "bigint", "CHAR": "string", "DATETIME": "timestamp_ntz"}

_TOKEN = re.compile(
    r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`|[A-Za-z_][\w$]*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\s+|.", re.S)


def date_pattern(pattern: str, codes: dict[str, str] = PRINT_CODES) -> str:
    """``%Y-%m-%dT%H`` -> ``yyyy-MM-dd'T'HH``. A pattern without ``%`` is taken as Spark's own."""
    if "%" not in pattern:
        return pattern
    out = []
    for code, plain in re.findall(r"%(.)|([^%]+)", pattern, re.S):
        if code == "%":
            out.append("%")
        elif code:
            if code not in codes:
                raise ValueError(f"date pattern code %{code} is not supported")
            out.append(codes[code])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", plain))
    return "".join(out)


def _pattern_argument(arguments: str) -> tuple[str, str]:
    m = re.fullmatch(r"(.*),\s*(['\"])([^'\"]*)\2\s*", arguments, re.S)
    if not m:
        raise ValueError("the date pattern must be a quoted text")
    return m[1], m[3]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _date_format(arguments: str) -> str:
    value, pattern = _pattern_argument(arguments)
    return f"date_format(try_cast({value} as timestamp), {_quoted(date_pattern(pattern))})"


def _str_to_date(arguments: str) -> str:
    value, pattern = _pattern_argument(arguments)
    codes = re.findall(r"%(.)", pattern, re.S)
    reader = "try_to_timestamp" if any(code in TIME_CODES for code in codes) else "try_to_date"
    read = f"{reader}(trim(cast({value} as string)), {_quoted(date_pattern(pattern, READ_CODES))})"
    if "y" in codes:  # Spark takes every two digits for 2000 to 2099
        return f"if(year({read}) >= 2070, {read} - interval '100' year, {read})"
    return read


def _cast(arguments: str) -> str:
    def rename(m: re.Match) -> str:
        return f" as {CAST_TYPES[m[1].upper()]}"
    cut = re.fullmatch(r"(.*)\s+as\s+char\s*\(\s*(\d+)\s*\)\s*", arguments, flags=re.I | re.S)
    if cut:
        return f"left(try_cast({cut[1]} as string), {cut[2]})"
    names = "|".join(CAST_TYPES)
    return "try_cast(" + re.sub(
        rf"\s+as\s+({names})\b(\s+integer)?(\s*\(\s*\d+\s*\))?\s*$", rename, arguments, flags=re.I) + ")"


def _arguments(text: str) -> list[str]:
    """The arguments of a call, parted at the commas outside of parentheses."""
    parts, depth = [""], 0
    for token in _TOKEN.findall(text):
        depth += (token == "(") - (token == ")")
        if token == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += token
    return [part.strip() for part in parts]


def _substring(arguments: str) -> str:
    given = _arguments(arguments)
    call = f"substring({', '.join(given)})"
    if len(given) < 2 or re.fullmatch(r"[1-9]\d*", given[1]):
        return call
    text, start = given[:2]
    return f"if(({start}) = 0 or ({start}) < -char_length({text}), left({text}, 0), {call})"


_CALLS = {
    "LENGTH": lambda a: f"octet_length({a})",
    "DATE": lambda a: f"try_cast(({a}) as date)",
    "CAST": _cast,
    "DATE_FORMAT": _date_format,
    "STR_TO_DATE": _str_to_date,
    "SUBSTRING": _substring,
    "SUBSTR": _substring,
}


def _skip_space(tokens: list[str], at: int) -> int:
    while at < len(tokens) and tokens[at].isspace():
        at += 1
    return at


def _closing(tokens: list[str], at: int, opens: str = "(", closes: str = ")") -> int:
    depth = 0
    for i in range(at, len(tokens)):
        word = tokens[i].upper()
        depth += (word == opens) - (word == closes)
        if depth == 0:
            return i
    raise ValueError("unbalanced expression: " + "".join(tokens))


def _operand_end(tokens: list[str], at: int) -> int:
    """Index after the operand that starts at ``at``: sign, then name, call, number or parentheses."""
    at = _skip_space(tokens, at)
    while at < len(tokens) and tokens[at] in "+-":
        at = _skip_space(tokens, at + 1)
    if at >= len(tokens):
        raise ValueError("missing divisor: " + "".join(tokens))
    if tokens[at] == "(":
        return _closing(tokens, at) + 1
    if tokens[at].upper() == "CASE":
        return _closing(tokens, at, "CASE", "END") + 1
    at += 1
    while at < len(tokens):
        if tokens[at] == ".":
            at += 2
        elif tokens[at] == "(":
            return _closing(tokens, at) + 1
        else:
            break
    return at


def _rewrite(tokens: list[str]) -> str:
    out, i = [], 0
    while i < len(tokens):
        token = tokens[i]
        after = _skip_space(tokens, i + 1)
        dotted = i > 0 and tokens[i - 1] == "."
        if token.upper() in _CALLS and after < len(tokens) and tokens[after] == "(" and not dotted:
            end = _closing(tokens, after)
            out.append(_CALLS[token.upper()](_rewrite(tokens[after + 1:end])))
            i = end + 1
        elif token in ("/", "%"):
            end = _operand_end(tokens, i + 1)
            out.append(f"{token} nullif({_rewrite(tokens[i + 1:end]).strip()}, 0)")
            i = end
        else:
            out.append(token)
            i += 1
    return "".join(out)


def spark_text(expression: str) -> str:
    """The expression as Spark SQL text with the meanings listed above."""
    return _rewrite(_TOKEN.findall(expression))


def expression(text: str) -> Column:
    """A configuration expression as a Column."""
    return F.expr(spark_text(text))
