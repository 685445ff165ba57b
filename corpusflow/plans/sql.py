"""Fragments of DuckDB SQL used by the equivalents of the registered queries."""

from __future__ import annotations

from functools import reduce

from corpusflow.functions.patterns import WHITESPACE_CHARS, literal_class, re2


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sub(expr: str, pattern: str, replacement: str = "", flags: str = "") -> str:
    replacement = quote(replacement.replace("$", "\\"))
    return f"regexp_replace({expr}, '{re2(pattern, flags)}', {replacement}, 'g')"


def chain(expr: str, *rules: tuple) -> str:
    return reduce(lambda e, rule: sub(e, *rule), rules, expr)


def match(expr: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({expr}, '{re2(pattern, flags)}')"


def match_any(expr: str, patterns) -> str:
    return "(" + " OR ".join(match(expr, p) for p in patterns) + ")"


def count(expr: str, pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({expr}, '{re2(pattern, flags)}'))"


def strip(expr: str) -> str:
    return f"trim({expr}, {quote(WHITESPACE_CHARS)})"


def lines(expr: str) -> str:
    return f"string_split({expr}, chr(10))"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{re2(chr(92) + 's+')}'), lambda w: w <> '')"


def translate(expr: str, table: dict[str, str]) -> str:
    return f"translate({expr}, {quote(''.join(table))}, {quote(''.join(table.values()))})"


def word_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def ends_with(expr: str, endings) -> str:
    return f"regexp_matches({expr}, '{re2(literal_class(endings))}$')"


def starts_with(expr: str, starts) -> str:
    return f"regexp_matches({expr}, '^{re2(literal_class(starts))}')"


def contains_any(expr: str, values) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quote(v)})" for v in values) + ")"


def join(expr: str, separator: str = "\n") -> str:
    return f"array_to_string({expr}, {quote(separator)})"


TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def tokens(expr: str) -> str:
    return TOKENS.format(expr)
