"""Full-text query language: a small recursive parser from a string to a boolean tree of phrases.

Precedence from tight to loose: juxtaposition, NOT, AND, OR. Strings are barewords or quoted; `+` joins
strings to a phrase, a final `*` makes a prefix, `^` wants the start of a column, `column :` or `{columns} :` limits
columns, NEAR(a b, n) wants phrases close together.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

COLUMNS = ("content", "heading")
KNOWN = (*COLUMNS, "file_path")
OPERATORS = frozenset(("AND", "OR", "NOT", "NEAR"))


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Without:
    keep: object
    drop: object


def fold_words(text: str) -> tuple[str, ...]:
    """Index tokens of a string: folded runs of letters and digits."""
    flat = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return tuple(re.findall(r"[^\W_]+", flat))


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([(){}:+*^,]))')


def lex(query: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(query.rstrip())
    while at < end:
        m = _LEX.match(query, at)
        if not m or m.end() > len(query):
            raise QuerySyntaxError(query)
        out.append(("string", m[1].replace('""', '"')) if m[1] is not None else ("word", m[2]) if m[2] else (m[3], m[3]))
        at = m.end()
    return out


class Parser:
    def __init__(self, query: str) -> None:
        self.query, self.all, self.at = query, lex(query), 0

    def fail(self):
        raise QuerySyntaxError(self.query)

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.all[k] if k < len(self.all) else ("end", "")

    def take(self, kind: str) -> str:
        if self.peek()[0] != kind:
            self.fail()
        self.at += 1
        return self.all[self.at - 1][1]

    def operator(self, name: str) -> bool:
        if self.peek() == ("word", name):
            self.at += 1
            return True
        return False

    def parse(self):
        tree = self.either()
        if self.peek()[0] != "end":
            self.fail()
        return tree

    def either(self):
        parts = [self.both()]
        while self.operator("OR"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def both(self):
        parts = [self.without()]
        while self.operator("AND"):
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def without(self):
        tree = self.side()
        while self.operator("NOT"):
            tree = Without(tree, self.side())
        return tree

    def side(self):
        """A bracketed expression, or phrases side by side; the two do not mix."""
        if self.peek()[0] == "(":
            self.at += 1
            tree = self.either()
            self.take(")")
            if self.begins():
                self.fail()
            return tree
        scope = self.scope()
        if scope and self.peek()[0] == "(":
            self.at += 1
            tree = limited(self.either(), scope)
            self.take(")")
            if self.begins():
                self.fail()
            return tree
        parts = [self.near(scope)]
        while self.begins():
            if self.peek()[0] == "(":
                self.fail()
            parts.append(self.near(self.scope()))
        real = [p for p in parts if not (isinstance(p, Phrase) and not p.words)]
        parts = real or parts[:1]
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def begins(self) -> bool:
        kind, text = self.peek()
        return kind in ("string", "(", "{", "^") or kind == "word" and text not in ("AND", "OR", "NOT")

    def scope(self) -> tuple[str, ...] | None:
        if self.peek()[0] == "{":
            self.at += 1
            names = []
            while self.peek()[0] in ("word", "string"):
                names.append(self.peek()[1])
                self.at += 1
            self.take("}")
            self.take(":")
        elif self.peek()[0] in ("word", "string") and self.peek(1)[0] == ":":
            names = [self.peek()[1]]
            self.at += 2
        else:
            return None
        names = [n.lower() for n in names]
        if not names or any(n not in KNOWN for n in names):
            self.fail()
        return tuple(n for n in COLUMNS if n in names)

    def near(self, scope):
        columns = COLUMNS if scope is None else scope
        if self.peek() == ("word", "NEAR") and self.peek(1)[0] == "(":
            self.at += 2
            phrases, distance = [], 10
            while self.peek()[0] in ("word", "string", "^"):
                phrases.append(self.phrase(columns))
            if self.peek()[0] == ",":
                self.at += 1
                n = self.take("word")
                if not n.isdigit():
                    self.fail()
                distance = int(n)
            self.take(")")
            if not phrases:
                self.fail()
            return phrases[0] if len(phrases) == 1 else Near(tuple(phrases), distance)
        return self.phrase(columns)

    def phrase(self, columns) -> Phrase:
        initial = self.peek()[0] == "^"
        self.at += initial
        words: list[str] = []
        while True:
            kind, text = self.peek()
            if kind not in ("string", "word") or kind == "word" and text in ("AND", "OR", "NOT"):
                self.fail()
            self.at += 1
            words += fold_words(text)
            if self.peek()[0] != "+":
                break
            self.at += 1
        prefix = self.peek()[0] == "*"
        self.at += prefix
        return Phrase(tuple(words), prefix, initial, columns)


def limited(tree, scope):
    """The tree with every phrase limited to these columns."""
    if isinstance(tree, Phrase):
        return Phrase(tree.words, tree.prefix, tree.initial, tuple(c for c in tree.columns if c in scope))
    if isinstance(tree, Near):
        return Near(tuple(limited(p, scope) for p in tree.phrases), tree.distance)
    if isinstance(tree, Without):
        return Without(limited(tree.keep, scope), limited(tree.drop, scope))
    return type(tree)(tuple(limited(p, scope) for p in tree.parts))


def parse(query: str):
    """The tree of a query; QuerySyntaxError if it is none."""
    return Parser(query).parse()


def terms(query: str) -> list[str]:
    """Words of a query without operators and excluded words, quoted."""
    kept = [w for w in query.split() if w not in OPERATORS and not w.startswith("-")]
    return ['"' + x.replace('"', '""') + '"' for w in kept for x in re.findall(r"\w+", w)]


def has_operators(query: str) -> bool:
    return any(w in OPERATORS for w in query.split())


def phrases_of(tree) -> list[Phrase | Near]:
    """Leaves that count for the score, left to right."""
    if isinstance(tree, (Phrase, Near)):
        return [tree]
    if isinstance(tree, Without):
        return phrases_of(tree.keep)
    return [x for p in tree.parts for x in phrases_of(p)]
