"""Ordered rule sets as column expressions, and small numeric helpers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers see it, no-break and other Unicode spaces included.
SPACE = r"(?U)\s"


_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?[a-zA-Z]+\)|\{[\d,]+\}|.", re.S)
_WORD = "[0-9A-Za-z_]"


def _is_word(token: str) -> bool:
    return token in (r"\w", r"\d") or re.fullmatch(_WORD, token) is not None


def _alternatives(tokens: list[str], at: int, step: int) -> list[list[str]] | None:
    """Alternatives of the plain group that opens at (step 1) or closes at (step -1) a place; None for any other group."""
    depth, i = 0, at
    while 0 <= i < len(tokens):
        depth += {"(": 1, ")": -1}.get(tokens[i], 0)
        if not depth:
            break
        i += step
    if not 0 <= i < len(tokens):
        return None
    inside = tokens[min(at, i) + 1 : max(at, i)]
    if inside[:1] == ["?"]:
        if inside[1:2] != [":"]:
            return None
        inside = inside[2:]
    out, depth = [[]], 0
    for t in inside:
        depth += {"(": 1, ")": -1}.get(t, 0)
        if t == "|" and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _begins(tokens: list[str], at: int) -> bool:
    """Whether what begins at a place begins with a word character, whatever it matches."""
    if at >= len(tokens):
        return False
    if tokens[at] == "(":
        parts = _alternatives(tokens, at, 1)
        return parts is not None and all(p and _begins(p, 0) for p in parts) and _after(tokens, at)[:1] not in ("?", "*", "{")
    then = tokens[at + 1] if at + 1 < len(tokens) else ""
    return _is_word(tokens[at]) and (then[:1] not in ("?", "*", "{") or then == "?" and _begins(tokens, at + 2))


def _after(tokens: list[str], at: int) -> str:
    depth = 0
    for i in range(at, len(tokens)):
        depth += {"(": 1, ")": -1}.get(tokens[i], 0)
        if not depth:
            return tokens[i + 1] if i + 1 < len(tokens) else ""
    return ""


def _ends(tokens: list[str], at: int) -> bool:
    """Whether what ends at a place ends with a word character, whatever it matches."""
    if at < 0:
        return False
    if tokens[at] == ")":
        parts = _alternatives(tokens, at, -1)
        return parts is not None and all(p and _ends(p, len(p) - 1) for p in parts)
    if tokens[at] == "+":
        return at > 0 and _is_word(tokens[at - 1])
    if tokens[at] == "?":
        return at > 1 and _is_word(tokens[at - 1]) and _ends(tokens, at - 2)
    return _is_word(tokens[at])


@lru_cache(1000)
def java(pattern: str) -> str:
    r"""``pattern`` with ``\b`` between ASCII words and anything else, accented letters included.

    Java's own boundary knows letters of all scripts, so that ``\bAI\b`` would
    not be in "AIÊ"; rules are written for boundaries of ASCII words. Where
    whatever stands beside is a word character, one look suffices.
    """
    tokens = _TOKEN.findall(pattern)
    out = []
    for i, token in enumerate(tokens):
        if token != r"\b":
            out.append(token)
        elif _begins(tokens, i + 1):
            out.append(f"(?<!{_WORD})")
        elif _ends(tokens, i - 1):
            out.append(f"(?!{_WORD})")
        else:
            out.append(f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))")
    return "".join(out)


@lru_cache(1000)
def literal_of(pattern: str) -> str:
    """The longest literal that whatever ``pattern`` matches must hold, in lower case; empty if there is none to be sure of."""
    best, run, depth = "", "", 0
    tokens = [t for t in _TOKEN.findall(pattern) if not t.startswith("(?") or not t.endswith(")") or len(t) > 5]
    for i, token in enumerate(tokens):
        then = tokens[i + 1] if i + 1 < len(tokens) else ""
        if token == "|" and not depth:
            return ""
        depth += {"(": 1, ")": -1}.get(token, 0)
        if not depth and re.fullmatch(r"\\[^0-9A-Za-z]|[0-9A-Za-z &-]", token) and then[:1] not in ("?", "*", "{"):
            run += token[-1]
            best = max(best, run, key=len)
            if then != "+":
                continue
        if token != r"\b":
            run = ""
    return best.lower()


@lru_cache(1000)
def literals_of(pattern: str) -> tuple[str, ...]:
    """Literals in lower case of which whatever ``pattern`` matches must hold one; none if there are none to be sure of."""
    found = [(literal_of(pattern),)]
    tokens = ["(", "?", ":", *(t for t in _TOKEN.findall(pattern) if not re.fullmatch(r"\(\?[a-zA-Z]+\)", t)), ")"]
    parts = _alternatives(tokens, 0, 1) or []
    if len(parts) == 1:
        depth, tokens = 0, parts[0]
        for at, token in enumerate(tokens):
            then = _after(tokens, at) if token == "(" else tokens[at + 1] if at + 1 < len(tokens) else ""
            if token == "(" and not depth and then[:1] not in ("?", "*", "{"):
                found.append(tuple(x for p in _alternatives(tokens, at, 1) or [[""]] for x in literals_of("".join(p)) or ("",)))
            # A digit is one of ten, and with what stands before it far rarer than that.
            if token == r"\d" and at and not depth and then[:1] not in ("?", "*") and not then.startswith("{0") and re.fullmatch(r"\\[^0-9A-Za-z]|[0-9A-Za-z-]", tokens[at - 1]):
                found.append(tuple(f"{tokens[at - 1][-1].lower()}{d}" for d in range(10)))
            depth += {"(": 1, ")": -1}.get(token, 0)
    else:
        found.append(tuple(x for p in parts for x in literals_of("".join(p)) or ("",)))
    # The longer the shortest, the fewer texts hold one.
    best = max(found, key=lambda x: min(map(len, x), default=0))
    return tuple(dict.fromkeys(best)) if best and all(best) else ()


@lru_cache(1000)
def parts_of(pattern: str) -> tuple[str, ...]:
    """Patterns of which a text matches one just if it matches ``pattern``: one for each alternative of its first plain group, unless that is repeated."""
    if re.search(r"\\[1-9]", pattern):
        return (pattern,)
    every = _TOKEN.findall(pattern)
    flags, tokens = "".join(t for t in every if re.fullmatch(r"\(\?[a-zA-Z]+\)", t)), [t for t in every if not re.fullmatch(r"\(\?[a-zA-Z]+\)", t)]
    whole = _alternatives(["(", "?", ":", *tokens, ")"], 0, 1) or []
    if len(whole) > 1:
        return tuple(flags + "".join(p) for p in whole)
    depth = 0
    for at, token in enumerate(tokens):
        parts = _alternatives(tokens, at, 1) if token == "(" and not depth and _after(tokens, at)[:1] not in ("?", "*", "+", "{") else None
        if parts:
            # The group ends where as many are closed as opened.
            end = next(i for i in range(at, len(tokens)) if tokens[at : i + 1].count("(") == tokens[at : i + 1].count(")"))
            return tuple(f"{flags}{''.join(tokens[:at])}(?:{''.join(p)}){''.join(tokens[end + 1 :])}" for p in parts)
        depth += {"(": 1, ")": -1}.get(token, 0)
    return (pattern,)


def shown_in(text: Column, low: Column, pattern: str) -> Column:
    """As :func:`found_in`, alternative by alternative: of many, a text holds the literals of few."""
    return reduce(or_, (found_in(text, low, p) for p in parts_of(pattern)))


def found_in(text: Column, low: Column, pattern: str) -> Column:
    """As :func:`matches`, with ``low`` the text in lower case: most texts lack a literal that a match must hold, and looking for that is far quicker."""
    literals = literals_of(pattern)
    if not literals:
        return matches(text, pattern)
    return reduce(or_, (low.contains(x) for x in literals)) & matches(text, pattern)


def matches(text: Column, pattern: str) -> Column:
    """Whether ``text`` has a match, with boundaries of ASCII words."""
    return text.rlike(java(pattern))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_low(text: Column) -> Column:
    return F.struct(text.alias("text"), F.lower(text).alias("low"))


def first_match(text: Column, rules: Iterable[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first (label, pattern) that ``text`` matches; null text matches none."""
    first = lambda x: F.coalesce(*(F.when(found_in(x["text"], x["low"], p), F.lit(label)) for label, p in rules), F.lit(default).cast("string"))
    return once(with_low(text), first)


def matched_text(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """What the first matching pattern matched."""
    return F.coalesce(*(F.when(matches(text, p), F.regexp_extract(text, java(p), 0)) for _, p in rules), F.lit(None).cast("string"))


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """The value of ``key`` in a small fixed table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default)) if default is not None else F.element_at(F.create_map(*pairs), key)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds half up towards positive infinity, negative numbers too."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}++\z|\A{SPACE}+", "")


def collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, rf"{SPACE}+", " "))


def known(text: Column, unknown: str = "Unknown") -> Column:
    """Null for the sentinel that sources use for what they don't tell."""
    return F.nullif(text, F.lit(unknown))
