"""Many patterns looked for at once: one automaton over the folded text, the patterns themselves only where it points.

A rule is a pattern of alternatives.  Most alternatives are plain keywords, or spell out to
a few (``f(ö|oe)rder``): where the automaton finds one, the rule matches.  Of any other
alternative the automaton knows the longest part that every match must hold, and the
alternative is tried only on texts that hold it.  Alternatives bound to the start of the text
are one pattern, tried at the start alone.  What has no fixed part is always tried.

The results are those of Python's ``re`` with IGNORECASE: folding maps every character to
the lower-case form that ``re`` takes it for.  A text is read once, however many rules there
are; texts travel in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Long s, the Kelvin sign and the dotted and dotless i: letters that ``re`` takes for s, k and i.
_FOLD = str.maketrans("ſKİı", "skii")
_PLAIN = re.compile(r"[\w -]+")


def folded(text: str) -> str:
    return text.translate(_FOLD).lower()


def _after(pattern: str, i: int) -> int:
    """The place after the escape, class, group or character that begins at i."""
    if pattern[i] == "\\":
        return i + 2
    if pattern[i] == "[":
        i += 2 if pattern[i + 1] in "^]" else 1
        i += pattern[i - 1 : i + 1] == "^]"  # a bracket that comes first is a character
        while pattern[i] != "]":
            i += 2 if pattern[i] == "\\" else 1
    elif pattern[i] == "(":
        i += 1
        while pattern[i] != ")":
            i = _after(pattern, i)
    return i + 1


def alternatives(pattern: str) -> list[str]:
    """The parts between the bars outside of groups and classes."""
    parts, start, i = [], 0, 0
    while i < len(pattern):
        if pattern[i] == "|":
            parts.append(pattern[start:i])
            start = i + 1
        i = _after(pattern, i)
    return [*parts, pattern[start:]]


def spelled(alternative: str) -> list[str]:
    """The plain keywords that an alternative stands for; none if it is more than keywords and groups of them."""
    groups = re.split(r"\(([\w|]+)\)", alternative)
    if not all(_PLAIN.fullmatch(g) or not g for g in groups[::2]):
        return []
    return ["".join(x) for x in product(*[g.split("|") if k % 2 else [g] for k, g in enumerate(groups)])]


def fixed_part(alternative: str) -> str:
    """The longest run of characters, folded, that every match of an alternative holds; '' if none is certain."""
    runs, now, i = [], "", 0
    while i < len(alternative):
        c, after = alternative[i], _after(alternative, i)
        if c == "\\" and not alternative[i + 1].isalnum():
            now += alternative[i + 1]
        elif c in "?*{":  # the character before may be missing
            runs, now = [*runs, now[:-1]], ""
            after = alternative.index("}", i) + 1 if c == "{" else after
        elif c in "\\([+.^$":
            runs, now = [*runs, now], ""
        else:
            now += c
        i = after
    return folded(max([*runs, now], key=len))


class Scanner:
    """For each of several patterns, whether it is found in a text."""

    def __init__(self, patterns: Sequence[str]):
        import ahocorasick

        self.patterns = len(patterns)
        self.starts: list[tuple[int, re.Pattern]] = []
        self.always: list[tuple[int, re.Pattern]] = []
        #: What a found part stands for: patterns that match, and alternatives to be tried.
        found: dict[str, tuple[set[int], set[int]]] = {}
        self.tried: list[tuple[int, re.Pattern]] = []
        for k, pattern in enumerate(patterns):
            others = []
            for alternative in alternatives(pattern):
                words = spelled(alternative)
                for word in words:
                    found.setdefault(folded(word), (set(), set()))[0].add(k)
                if not words:
                    others.append(alternative)
            bound = [a for a in others if a.startswith("^")]
            if bound:
                self.starts.append((k, re.compile("|".join(f"(?:{a[1:]})" for a in bound), re.IGNORECASE)))
            for a in others:
                if a.startswith("^"):
                    continue
                part = fixed_part(a)
                if part:
                    found.setdefault(part, (set(), set()))[1].add(len(self.tried))
                    self.tried.append((k, re.compile(a, re.IGNORECASE)))
                else:
                    self.always.append((k, re.compile(a, re.IGNORECASE)))
        #: By number of the found part.
        self.sure, self.maybe = [s for s, _ in found.values()], [m for _, m in found.values()]
        self.automaton = ahocorasick.Automaton()
        for i, part in enumerate(found):
            self.automaton.add_word(part, i)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> set[int]:
        """The numbers of the patterns that are found."""
        out = {k for k, p in self.starts if p.match(text)} | {k for k, p in self.always if p.search(text)}
        parts = {i for _, i in self.automaton.iter(folded(text))} if len(self.automaton) else ()
        for i in parts:
            out |= self.sure[i]
        for i in {i for part in parts for i in self.maybe[part]}:
            k, pattern = self.tried[i]
            if k not in out and pattern.search(text):
                out.add(k)
        return out


@lru_cache(maxsize=32)
def scanner(patterns: tuple[str, ...]) -> Scanner:
    return Scanner(patterns)


def labels_found(text: Column, table: Sequence[tuple[str, str]]) -> Column:
    """array<string>: the labels of the patterns of a table (pattern, label) that are found, in its order, each once; none for null."""
    patterns, labels = tuple(p for p, _ in table), [label for _, label in table]

    def run(texts: pd.Series) -> pd.Series:
        scan = scanner(patterns)
        return texts.map(lambda t: [] if t is None else list(dict.fromkeys(labels[k] for k in sorted(scan(t)))))

    return F.pandas_udf(run, "array<string>")(text)


def any_found(text: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns is found; not in null."""
    chosen = tuple(patterns)

    def run(texts: pd.Series) -> pd.Series:
        scan = scanner(chosen)
        return texts.map(lambda t: t is not None and bool(scan(t)))

    return F.pandas_udf(run, "boolean")(text)
