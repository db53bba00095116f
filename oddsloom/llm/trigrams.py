"""What a text must hold, in trigrams, to match a regular expression.

A query is True (any text may match), a trigram in lower case, or ("and" | "or", parts). It is a necessary
condition only: a text that matches satisfies it, in whatever case its letters are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product
from re import _parser

#: Strings a stretch of a pattern may stand for, and letters of a class, before it is cut there.
MOST_STRINGS = 64
MOST_LETTERS = 8


def both(parts: Iterable):
    """All of the parts."""
    return _joined("and", True, parts)


def either(parts: Iterable):
    """At least one of the parts."""
    parts = list(parts)
    if True in parts:
        return True
    # A way that asks for more than another way does adds nothing.
    needs = [trigrams(p) if isinstance(p, str) or p[0] == "and" and all(isinstance(x, str) for x in p[1]) else None for p in parts]
    more = [a is not None and any(b is not None and (b < a or b == a and j < i) for j, b in enumerate(needs)) for i, a in enumerate(needs)]
    return _joined("or", None, [p for p, drop in zip(parts, more, strict=True) if not drop])


def _joined(word: str, neutral, parts: Iterable):
    flat = []
    for part in parts:
        inner = part[1] if isinstance(part, tuple) and part[0] == word else [part]
        flat += [x for x in inner if x is not neutral and x not in flat]
    return neutral if not flat else flat[0] if len(flat) == 1 else (word, flat)


def _of(strings: set[str]):
    """One of these strings occurs."""
    return either(both(s[k : k + 3] for k in range(len(s) - 2)) for s in sorted(strings))


def trigram_query(pattern: str):
    """The query of a pattern; letters are taken in either case."""
    strings, query = _walk(_parser.parse(pattern))
    return both([query, True if strings is None else _of(strings)])


def _walk(items) -> tuple[set[str] | None, object]:
    """(all strings the items can match, or None; query of what they hold besides)."""
    open_, found, whole = {""}, [], True
    for kind, value in items:
        strings, query = _single(str(kind), value)
        found.append(query)
        if strings is not None and len(open_) * len(strings) <= MOST_STRINGS:
            open_ = {a + b for a, b in product(open_, strings)}
            continue
        # What came so far is a stretch of its own; what follows starts a new one.
        found.append(_of(open_))
        open_, whole = strings if strings is not None else {""}, False
    if not whole:
        return None, both([*found, _of(open_)])
    return open_, both(found)


def _single(kind: str, value) -> tuple[set[str] | None, object]:
    if kind == "LITERAL":
        return {chr(value).lower()}, True
    if kind == "IN":
        letters = _letters(value)
        return (letters, True) if letters and len(letters) <= MOST_LETTERS else (None, True)
    if kind == "SUBPATTERN":
        return _walk(value[-1])
    if kind == "BRANCH":
        ways = [_walk(way) for way in value[1]]
        if all(strings is not None for strings, _ in ways):
            together = set().union(*(strings for strings, _ in ways))
            if len(together) <= MOST_STRINGS:
                return together, either(query for _, query in ways)
        return None, either(both([query, True if strings is None else _of(strings)]) for strings, query in ways)
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = value
        strings, query = _walk(inner)
        if most == 1:
            return (strings | {""} if strings is not None else None), query if least else True
        if least == 0:
            return None, True
        if strings is not None and least == most and len(strings) ** least <= MOST_STRINGS:
            return {"".join(way) for way in product(strings, repeat=least)}, query
        return None, both([query, True if strings is None else _of(strings)])
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, True
    # Anything else (any character, categories, back references) says nothing.
    return None, True


def _letters(choices) -> set[str] | None:
    out: set[str] = set()
    for kind, value in choices:
        if str(kind) == "LITERAL":
            out.add(chr(value).lower())
        elif str(kind) == "RANGE" and value[1] - value[0] < 2 * MOST_LETTERS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out


def trigrams(query) -> set[str]:
    """All trigrams a query names."""
    if isinstance(query, tuple):
        return set().union(*(trigrams(part) for part in query[1]))
    return {query} if isinstance(query, str) else set()


def evaluate(query, holds: Callable[[str], object], conjoin: Callable, disjoin: Callable):
    """The query over any truth values: `holds` gives that of a trigram, the other two combine a list of them."""
    if isinstance(query, tuple):
        parts = [evaluate(part, holds, conjoin, disjoin) for part in query[1]]
        return conjoin(parts) if query[0] == "and" else disjoin(parts)
    return holds(query)


def lookahead(words: Iterable[str]) -> str:
    """A pattern whose group 1 is each of the words at each place where it stands, overlaps included.

    Words are told apart letter by letter, so that most places fail at their first character."""
    words = sorted(words)
    firsts = "".join(_escaped(c) for c in sorted({w[0] for w in words}))
    return f"(?=[{firsts}])(?=({_tree(words)}))"


def _escaped(c: str) -> str:
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"


def _tree(words: list[str]) -> str:
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    ways = [_escaped(c) + (_tree(rest) if rest[0] else "") for c, rest in heads.items()]
    return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"
