"""One pattern text for two regex engines.

Patterns in `fixed_values` use Unicode-aware shorthands.  Spark (java.util.regex) and DuckDB (RE2) read those shorthands
as ASCII by default, so they are spelled out as character classes that mean the same in both.
"""

from __future__ import annotations

# str.isspace() members; both engines accept \x{..}
WHITESPACE = " \\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
WORD = "\\p{L}\\p{N}_"
DIGIT = "\\p{Nd}"
WHITESPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_CLASSES = {"s": WHITESPACE, "w": WORD, "d": DIGIT}


def unicode_classes(pattern: str) -> str:
    """Spell out \\s \\w \\d \\S \\W \\D, inside and outside brackets."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            kind = pattern[i + 1]
            if kind in _CLASSES:
                out.append(_CLASSES[kind] if inside else f"[{_CLASSES[kind]}]")
            elif kind.lower() in _CLASSES and not inside:
                out.append(f"[^{_CLASSES[kind.lower()]}]")
            else:
                out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            if inside:
                out.append("\\[")
                i += 1
                continue
            inside = True
        elif c == "]" and inside and out[-1] not in ("[", "^"):
            inside = False
        out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str, flags: str = "") -> str:
    """Pattern for Spark.  `d` makes `.`, `^` and `$` treat only \\n as a line end, as Python and RE2 do."""
    if pattern.startswith("(?i)"):
        pattern, flags = pattern[4:], flags + "i"
    spelled = {"i": "iu", "m": "m", "s": "s", "b": "U"}
    return f"(?d{''.join(spelled[f] for f in flags)}){unicode_classes(pattern)}"


def re2(pattern: str, flags: str = "") -> str:
    """Pattern for DuckDB, written as the inside of a single-quoted SQL literal."""
    if pattern.startswith("(?i)"):
        pattern, flags = pattern[4:], flags + "i"
    flags = flags.replace("b", "")
    return ((f"(?{flags})" if flags else "") + unicode_classes(pattern)).replace("'", "''")


def literal_class(words) -> str:
    """Alternation of escaped words, for endings and starters."""
    special = set("\\.[]{}()*+?^$|")
    return "(?:" + "|".join("".join("\\" + c if c in special else c for c in w) for w in words) + ")"
