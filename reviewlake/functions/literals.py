"""What every text that a pattern matches must contain.

A pattern is read once into a query: alternatives become disjunctions, parts that
follow each other become conjunctions.  Case is folded, so the query holds for any
flags; what the reader does not know counts as unknown and asks for nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

#: Strings that a part of a pattern may expand to before it counts as unknown.
EXPANSIONS = 64
SHORTEST = 2


def all_of(*queries):
    """Conjunction; None is true."""
    parts = {q for q in queries if q is not None}
    return None if not parts else parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def any_of(queries):
    """Disjunction; true as soon as one side is, without sides that ask for more than another."""
    queries = set(queries)
    asked = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in queries}
    queries = {q for q in queries if not any(asked[o] < asked[q] for o in queries)}
    return None if None in queries or not queries else queries.pop() if len(queries) == 1 else ("or", frozenset(queries))


def one_word(strings) -> object:
    """A text must hold one of the strings; short or non-ASCII ones ask for nothing."""
    return any_of(s if len(s) >= SHORTEST and s.isascii() else None for s in strings)


class PatternReader:
    """Query of a pattern, given what each set of possible strings asks for.

    A part is (strings, query): all strings it can match, or None if unknown, and
    what a text must hold beside them.  Syntax that is not known raises ValueError.
    """

    def __init__(self, pattern: str, needs: Callable = one_word):
        self.p, self.at, self.needs = pattern, 0, needs

    def query(self):
        query = self.asked(*self.alternatives())
        if self.at != len(self.p):
            raise ValueError(f"unbalanced pattern: {self.p}")
        return query

    def asked(self, strings, query):
        return all_of(query, self.needs(strings) if strings is not None else None)

    def peek(self, n=1):
        return self.p[self.at:self.at + n]

    def alternatives(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        if all(s is not None and q is None for s, q in branches):
            return self.bounded(set().union(*(s for s, _ in branches)))
        return None, any_of(self.asked(*b) for b in branches)

    def bounded(self, strings):
        return (strings, None) if len(strings) <= EXPANSIONS else (None, self.needs(strings))

    def sequence(self):
        run, query, whole = {""}, None, True
        while self.at < len(self.p) and self.peek() not in "|)":
            strings, more = self.repeated(self.atom())
            query = all_of(query, more)
            if strings is not None and len(run) * len(strings) <= EXPANSIONS:
                run = {a + b for a in run for b in strings}
                continue
            query, whole = all_of(query, self.needs(run)), False
            run = strings if strings is not None else {""}
        return (run, query) if whole else (None, all_of(query, self.needs(run)))

    def repeated(self, part):
        strings, query = part
        while m := re.compile(r"[*+?]|\{(\d+)(,?)(\d*)\}").match(self.p, self.at):
            self.at = m.end()
            if self.peek() in ("?", "+"):
                self.at += 1  # lazy and possessive repeats need the same
            low = int(m[1]) if m[1] else int(m[0] == "+")
            if m[0] == "?" and strings is not None and query is None:
                strings = strings | {""}
            elif not (m[1] and not m[2] and low == 1):
                query, strings = (self.asked(strings, query) if low else None), None
        return strings, query

    def atom(self):
        c = self.peek()
        self.at += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.char_class()
        if c in "^$":
            return {""}, None
        if c == ".":
            return None, None
        if c == "\\":
            return self.escaped()
        return {c.lower()}, None

    def group(self):
        m = re.compile(r"\?(?:([aiLmsu]*)([:)])|P?<[A-Za-z]\w*>|(<?[=!])|>)").match(self.p, self.at)
        if m:
            self.at = m.end()
            if m[2] == ")":  # flags for the rest
                return {""}, None
        elif self.peek() == "?":
            raise ValueError(f"unknown group: {self.p}")
        part = self.alternatives()
        if self.peek() != ")":
            raise ValueError(f"unbalanced pattern: {self.p}")
        self.at += 1
        return ({""}, None) if m and m[3] else part

    def escaped(self):
        c = self.peek()
        self.at += 1
        if m := re.compile("[0-9A-Fa-f]{2}").match(self.p, self.at) if c == "x" else None:
            self.at = m.end()
            return {chr(int(m[0], 16)).lower()}, None
        if c in tuple("bBAZz"):
            return {""}, None
        if c in tuple("wWdDsS123456789"):
            return None, None
        if not c or c.isalnum() and c not in "ntrfv":
            raise ValueError(f"unknown escape: {self.p}")
        return {{"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}.get(c, c)}, None

    def char_class(self):
        end = self.at + (self.peek() == "^")
        end += self.p[end:end + 1] == "]"
        while self.p[end:end + 1] != "]":
            if end >= len(self.p) or self.p[end] == "[" or self.p[end:end + 2] == "&&":
                raise ValueError(f"unknown class: {self.p}")
            end += 2 if self.p[end] == "\\" else 1
        body, self.at = self.p[self.at:end], end + 1
        if body[0] == "^" or re.search(r"\\|.-.", body):
            return None, None
        return self.bounded({x.lower() for x in body})


@lru_cache(maxsize=None)
def required_words(pattern: str, flags: str = "") -> object:
    """Query of lower-case words, true (None) when unknown."""
    if "x" in flags or re.search(r"\(\?[a-wyz]*x", pattern):
        return None
    try:
        return PatternReader(pattern).query()
    except ValueError:
        return None


def reads_context(pattern: str) -> bool:
    """Whether a match may depend on where the text begins or ends.

    Such a pattern can match a line and fail in the text around it: anchors,
    look-arounds, and groups and repeats that give nothing back.
    """
    plain = re.sub(r"\\[^AZzGbB]|\[\^?\]?(?:\\.|[^\]\\])*\]", "x", pattern)
    return bool(re.search(r"[\^$]|\\[AZzG]|\(\?(?:[=!>]|<[=!]|[a-z]*-?[a-z]*[)])|[*+?}]\+", plain))
