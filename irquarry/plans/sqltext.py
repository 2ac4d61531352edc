"""Spellings shared by the SQL of several queries."""

from __future__ import annotations

import string

WHITESPACE = "[ \t\n\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(expr: str) -> str:
    """Whitespace of any kind removed at both ends."""
    return f"regexp_replace({expr}, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')"


def sql_render(template: str, **values: str) -> str:
    """A template with its placeholders replaced by SQL expressions."""
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(quote(literal))
        if name:
            parts.append(f"({values[name]})")
    return " || ".join(parts)


UNCOMMENTED = (
    "array_to_string(list_transform(string_split({0}, chr(10)), lambda l: "
    "CASE WHEN contains(l, '#') THEN "
    + sql_strip("string_split(l, '#')[1]")
    + " ELSE l END), chr(10))"
)
