"""Helpers on one text at a time: a normal form that knows its source positions, and replacement by a dictionary.

No built-in function replaces by a dictionary or tells positions across a normal form. These run in
tasks, on texts that Spark has brought together with the entries of their case.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

#: A run of letters and digits, or any other code point alone.
TOKEN = re.compile(r"[^\W_]+|[\W_]")
#: A label in brackets, behind its bracket any number of escapes.
LABEL = re.compile(r"\[(\\*)([^\[\]\\]*)\]")
#: A word cut at the end of a line.
CUT = re.compile("(?<=[^\\W\\d_])[-‐­][ \t]*\r?\n[ \t]*(?=[^\\W\\d_])")
DIGITS = re.compile("[0-9]+")
#: What may stand inside of a number.
BETWEEN = re.compile(r"[\s./-]{1,3}")
# fixed values: letters that have no decomposition
PLAIN = {"æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}


class Forms(dict):
    """The normal form of each code point: lower case, no accents, ligatures apart, blanks alike; '' for marks."""

    def __missing__(self, c: str) -> str:
        if c.isspace():
            form = " "
        else:
            apart = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", c).casefold())
            form = "".join(PLAIN.get(x, x) for x in apart if unicodedata.category(x) not in ("Mn", "Cf"))
        self[c] = form
        return form


FORMS = Forms()


class Alike(dict):
    """The form of each code point by its number, where that is one code point; another mark stands for the rest."""

    def __missing__(self, n: int) -> str:
        form = FORMS[chr(n)]
        self[n] = form if len(form) == 1 else OTHER
        return self[n]


OTHER = "\uffff"
ALIKE = Alike()
#: Entries of a case up to which each is looked for by itself; a text is met with more of them token by token.
FEW = 16


def places(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def aligned(text: str) -> tuple[str, list[int], list[int]]:
    """(normal form, start, end) of a text: for each code point of the form where in the text it comes from.

    Accents may be composed or not, words may be cut at line ends, blanks are squeezed. Marks belong to the
    letter before them.
    """
    plain = text.translate(ALIKE)
    if OTHER not in plain and "  " not in plain and "\n" not in text:
        return plain, list(range(len(text))), list(range(1, len(text) + 1))
    out, starts, ends = [], [], []
    gaps = {m.start(): m.end() for m in CUT.finditer(text)} if "\n" in text else {}
    at = 0
    while at < len(text):
        if at in gaps:
            at = gaps[at]
            continue
        form = FORMS[text[at]]
        squeezed = form == " " and out and out[-1] == " "
        if ends and (squeezed or not form):
            ends[-1] = at + 1  # more of the same blank, or a mark of the letter before
        for c in "" if squeezed else form:
            out.append(c)
            starts.append(at)
            ends.append(at + 1)
        at += 1
    return "".join(out), starts, ends


def normal(text: str | None) -> str:
    return aligned(text or "")[0].strip()


def free(text: str, at: int) -> bool:
    """Whether no letter or digit stands at a place."""
    return not 0 <= at < len(text) or not text[at].isalnum()


class Register:
    """Names and numbers of one case's parties."""

    def __init__(self, entries: Iterable[tuple[str, str]]):
        self.names: dict[str, str] = {}
        self.numbers: set[str] = set()
        for kind, known in entries:
            if kind == "number":
                self.numbers.add(re.sub("[^0-9]", "", known))
            elif form := normal(known):
                self.names[form] = kind
        self.numbers.discard("")
        sizes = defaultdict(set)
        for name in self.names:
            sizes[TOKEN.match(name)[0]].add(len(name))
        self.sizes = {first: sorted(s) for first, s in sizes.items()}
        self.longest = max(map(len, self.numbers), default=0)

    def _names(self, form: str) -> Iterator[tuple[str, int, int]]:
        if len(self.names) <= FEW:
            for name, kind in self.names.items():
                done = 0
                for at in places(form, name):
                    if at >= done and free(form, at - 1) and free(form, at + len(name)):
                        done = at + len(name)
                        yield kind, at, done
            return
        after: dict[str, int] = {}
        for m in TOKEN.finditer(form):
            at = m.start()
            for size in self.sizes.get(m[0], ()) if free(form, at - 1) else ():
                name = form[at : at + size]
                if name in self.names and free(form, at + size) and after.get(name, 0) <= at:
                    after[name] = at + size
                    yield self.names[name], at, at + size

    def _numbers(self, form: str) -> Iterator[tuple[str, int, int]]:
        runs = [m.span() for m in DIGITS.finditer(form)] if self.numbers else []
        if len(self.numbers) <= FEW:  # all runs in one: most texts don't even hold the digits
            joined = "".join([form[a:b] for a, b in runs])
            if not any(n in joined for n in self.numbers):
                return
        after: dict[str, int] = {}
        for k, (at, end) in enumerate(runs):
            if not free(form, at - 1):
                continue
            digits, j = form[at:end], k
            while True:
                if digits in self.numbers and free(form, end) and after.get(digits, 0) <= at:
                    after[digits] = end
                    yield "number", at, end
                j += 1
                if len(digits) >= self.longest or j == len(runs) or not BETWEEN.fullmatch(form, end, runs[j][0]):
                    break
                digits, end = digits + form[runs[j][0] : runs[j][1]], runs[j][1]

    def found(self, text: str | None) -> list[dict]:
        """(kind, value, start, end) of all places; values as they stand in the text."""
        if not text or not (self.names or self.numbers):
            return []
        form, starts, ends = aligned(text)
        spans = [(kind, starts[a], ends[b - 1]) for part in (self._names, self._numbers) for kind, a, b in part(form)]
        return [{"kind": kind, "value": text[a:b], "start": a, "end": b} for kind, a, b in spans]


class Labels:
    """The labels of one case, made one to one, to mask its texts and to undo that.

    A value takes the smallest of its labels. Of several values under one label the first keeps it and the
    others get new ones. All labels are undone. A text that happens to hold a label in brackets gets an escape
    behind the bracket, so that unmask() gives back what mask() was given.
    """

    def __init__(self, entries: Iterable[tuple[str, str]], bounds: bool = True):
        pairs = sorted({(label, value) for label, value in entries if label and value})
        self.bounds, self.values, self.labels = bounds, {}, {}
        taken = {label for label, _ in pairs}
        for label, value in pairs:
            if self.labels.setdefault(label, value) != value:
                body, end = (label[:-1], "]") if label.endswith("]") else (label, "")
                label = next(x for k in count(2) if (x := f"{body}~{k}{end}") not in taken)  # noqa: PLW2901
                taken.add(label)
                self.labels[label] = value
            self.values.setdefault(value, label)
        sizes = defaultdict(set)
        for value in self.values:
            sizes[TOKEN.match(value)[0] if bounds else value[0]].add(len(value))
        self.sizes = {first: sorted(s, reverse=True) for first, s in sizes.items()}
        other = sorted((x for x in self.labels if not LABEL.fullmatch(x)), key=len, reverse=True)
        self.any = re.compile("|".join([LABEL.pattern, *map(re.escape, other)])) if other else LABEL

    def _value(self, text: str, first: str, at: int) -> str | None:
        """The longest value at a place."""
        for size in self.sizes.get(first, ()):
            value = text[at : at + size]
            if value in self.values and (not self.bounds or free(text, at - 1) and free(text, at + size)):
                return value
        return None

    def mask(self, text: str | None) -> str | None:
        if not text or not self.values:
            return text
        out, done = [], 0
        if len(self.values) <= FEW:
            for at, size, value in sorted([(at, -len(v), v) for v in self.values for at in places(text, v)] + [(at, 0, "") for at in places(text, "[")]):
                if at < done or value and self.bounds and not (free(text, at - 1) and free(text, at - size)):
                    continue
                if value:
                    out += (text[done:at], self.values[value])
                    done = at - size
                elif (m := LABEL.match(text, at)) and f"[{m[2]}]" in self.labels:
                    out += (text[done : at + 1], "\\", text[at + 1 : m.end()])
                    done = m.end()
            return "".join([*out, text[done:]])
        for first, at in ((m[0], m.start()) for m in TOKEN.finditer(text)) if self.bounds else zip(text, range(len(text)), strict=True):
            if at < done:
                continue
            if (value := self._value(text, first, at)) is not None:
                out += (text[done:at], self.values[value])
                done = at + len(value)
            elif first == "[" and (m := LABEL.match(text, at)) and f"[{m[2]}]" in self.labels:
                out += (text[done : at + 1], "\\")
                out.append(text[at + 1 : m.end()])
                done = m.end()
        return "".join([*out, text[done:]])

    def _back(self, m: re.Match) -> str:
        if m[2] is None or not m[1]:
            return self.labels.get(m[0], m[0])
        return f"[{m[1][1:]}{m[2]}]" if f"[{m[2]}]" in self.labels else m[0]

    def unmask(self, text: str | None) -> str | None:
        return self.any.sub(self._back, text) if text and self.labels else text
