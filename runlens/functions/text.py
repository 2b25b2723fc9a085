"""Column helpers for text: Python-like strip, word counts, truncation, names.

All are built-in Spark expressions (codegen, no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the characters Python's str.isspace() accepts ------------
PY_WS = "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

# Python's str.strip() removes all of them; Spark's trim only spaces.
_WS = f"^{PY_WS}+|{PY_WS}+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c) -> Column:
    """``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(_c(c), _WS, "")


def blank_to_null(c) -> Column:
    """NULL when the stripped text is empty (Python falsy after strip)."""
    s = pystrip(c)
    return F.when(s == "", F.lit(None)).otherwise(s)


def word_count(c) -> Column:
    """``len(text.split())``: number of whitespace-separated tokens."""
    s = pystrip(c)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, f"{PY_WS}+"))).cast("int")


def truncate_text(c, n: int, keep: int | None = None, suffix: str = "...") -> Column:
    """First ``keep`` chars + ``...`` when longer than ``n`` (keep defaults to n)."""
    keep = n if keep is None else keep
    col = _c(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, keep), F.lit(suffix))).otherwise(col)


def mask_raw_output(c) -> Column:
    """``[<len> chars]`` in place of the text."""
    return F.concat(F.lit("["), F.length(_c(c)).cast("string"), F.lit(" chars]"))


def sanitize_name(c) -> Column:
    """Replace path-unsafe characters by ``_``, collapse runs of ``_``, strip ``_``."""
    s = F.regexp_replace(_c(c), r'[/\\:*?"<>| ]', "_")
    s = F.regexp_replace(s, "_{2,}", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def lines(c) -> Column:
    """Array of lines (split on newline)."""
    return F.split(_c(c), "\n")


def nonblank_lines(c) -> Column:
    """Stripped non-empty lines."""
    return F.filter(F.transform(lines(c), lambda x: pystrip(x)), lambda x: x != "")


def last_nonblank_line(c) -> Column:
    return F.try_element_at(nonblank_lines(c), F.lit(-1))


def count_substr(c, needle: str) -> Column:
    """Non-overlapping occurrences of a literal substring (``str.count``)."""
    return F.regexp_count(_c(c), F.lit(_quote(needle)))


def _quote(s: str) -> str:
    """Escape a literal for Java regex."""
    out = []
    for ch in s:
        if ch in r".^$*+?()[]{}|\\/-":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


def quote_regex(s: str) -> str:
    return _quote(s)


# --- Python ``re`` semantics on the JVM ---------------------------------------
# Python's str patterns use Unicode classes: \w = letters, numbers and "_",
# \d = decimal digits, \s = the str.isspace() set, \b = a \w / non-\w edge.
# Java's own Unicode mode differs (its \w also takes combining marks and join
# controls), so the classes are spelled out.
_PY_W = r"\p{L}\p{N}_"
_PY_D = r"\p{Nd}"
_PY_S = PY_WS[1:-1]
_PY_CLASSES = {"w": _PY_W, "d": _PY_D, "s": _PY_S}
_PY_NEG = {"W": "w", "D": "d", "S": "s"}


def _word_literal(ch: str) -> bool:
    return ch.isascii() and (ch.isalnum() or ch == "_")


def _group_end(p: str, i: int) -> int:
    """Index of the ``)`` closing the group that opens at ``p[i]``, or -1."""
    depth, j, in_class = 0, i, False
    while j < len(p):
        c = p[j]
        if c == "\\":
            j += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return j
        j += 1
    return -1


def _alternatives(p: str, i: int, end: int) -> list[str]:
    """Top-level alternatives of the group ``p[i:end + 1]`` (no nested groups)."""
    body = p[i + 1:end]
    if body.startswith("?:"):
        body = body[2:]
    elif body.startswith("?"):
        return []
    if any(c in body for c in "()[\\"):
        return []
    return body.split("|")


def _next_is_word(p: str, i: int) -> bool:
    """Whatever comes at ``p[i]`` starts with a word character."""
    if i >= len(p):
        return False
    if _word_literal(p[i]):
        return True
    if p[i] == "\\" and i + 1 < len(p) and p[i + 1] in "wd":
        return True
    if p[i] == "(":
        end = _group_end(p, i)
        alts = _alternatives(p, i, end) if end > 0 else []
        return bool(alts) and all(a and _word_literal(a[0]) for a in alts)
    return False


def _prev_is_word(p: str, i: int) -> bool:
    """Whatever ends just before ``p[i]`` ends with a word character."""
    if i == 0:
        return False
    c = p[i - 1]
    if _word_literal(c):
        return not (i >= 2 and p[i - 2] == "\\")
    if c == ")":
        # find the opening parenthesis of this group
        for j in range(i - 1, -1, -1):
            if p[j] == "(" and _group_end(p, j) == i - 1:
                alts = _alternatives(p, j, i - 1)
                return bool(alts) and all(a and _word_literal(a[-1]) for a in alts)
    return False


def py_regex(pattern: str, flags: str = "") -> str:
    """A Java regex matching what Python's ``re`` matches for ``pattern``
    (str pattern) with the given flags (``i``, ``m``, ``s``).

    A word edge next to a certain word character needs only one lookaround
    (much faster than the general two-sided form)."""
    out = []
    i, n, in_class = 0, len(pattern), False
    w = f"[{_PY_W}]"
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt in _PY_CLASSES:
                body = _PY_CLASSES[nxt]
                out.append(body if in_class else f"[{body}]")
            elif nxt in _PY_NEG and not in_class:
                out.append(f"[^{_PY_CLASSES[_PY_NEG[nxt]]}]")
            elif nxt == "b" and not in_class:
                after, before = _next_is_word(pattern, i + 2), _prev_is_word(pattern, i)
                if after and before:
                    out.append("(?!)")
                elif after:
                    out.append(f"(?<!{w})")
                elif before:
                    out.append(f"(?!{w})")
                else:
                    out.append(f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))")
            elif nxt == "B" and not in_class:
                out.append(f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if in_class:
            if ch == "]" and not (out and out[-1] in ("[", "[^")):
                in_class = False
        elif ch == "[":
            in_class = True
            if i + 1 < n and pattern[i + 1] == "^":
                out.append("[^")
                i += 2
                continue
        out.append(ch)
        i += 1
    # d: only \n ends a line; u: Unicode case folding, as Python's IGNORECASE
    return f"(?{flags}du)" + "".join(out)
