"""Secrets in texts: three plain patterns, and literals that flow into sensitive names.

Assignment-aware lexing reads a text as source code or configuration and turns it into name-literal pairs: ``=``,
``:``, ``:=``, ``=>`` assignments, mappings, keyword arguments, attributes and elements, setters, command line
options, definitions and passwords in addresses. A constant that another name is assigned from counts for that name
too, also when values are joined from several constants. A literal's score is the weight of the most sensitive name
it reaches, times the strength of the value that name gets.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import pairwise
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.common import small_batches, texts

KINDS = ("assign", "access", "hex", "literal")
LEAST_SCORE = 0.45
STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: How sensitive a name is by the words in it, and by two words side by side.
WORD_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passwort": 1.0, "pwd": 1.0, "pass": 0.8, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "authorization": 0.8, "auth": 0.6, "key": 0.4, "dsn": 0.5, "salt": 0.4,
}
KEY_WORDS = {"api", "access", "private", "auth", "encryption", "signing", "account", "master", "session", "client", "license", "storage", "service"}
#: A name that ends so is about a secret, but holds none.
HARMLESS_ENDS = {"file", "path", "name", "id", "url", "uri", "field", "label", "prompt", "placeholder", "length", "type", "hint", "expires", "count", "policy", "regex", "help", "title", "ttl", "limit"}
PLACEHOLDER = re.compile(r"(?i)change_?me|example|sample|dummy|placeholder|redacted|todo|your[_-]?|^(none|null|nil|true|false|undefined|default|test)$|^(.)\2*$|[<>{}]|\*{3}|\.{3}|x{4}")
#: Names of settings, and unquoted words that can only be names.
SETTING = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+")
PLAIN_NAME = re.compile(r"[A-Za-z_]+(?:[.\-][A-Za-z_]+)*")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
TOKEN = re.compile(
    r'''(?P<string>(?:\b[rbfuRBFU]{1,2})?(?:"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|(?<![^\W_])\'(?:[^'\\\n]|\\.)*\'|`[^`\n]*`))'''
    r"|(?P<ref>\$\{[^{}\n]*\}|\{\{[^{}\n]*\}\}|%[A-Za-z_]\w*%|\$[A-Za-z_]\w*)"
    r"|(?P<url>\b[A-Za-z][A-Za-z0-9]{1,15}://[^\s:/@]+:(?P<pass>[^\s@/]+)@)"
    r"|(?P<flag>(?<!\S)--?(?=[A-Za-z]))"
    r"|(?P<name>[A-Za-z_]\w*(?:[.\-][A-Za-z_]\w*)*)"
    r"|(?P<op>:=|=>|==|!=|<=|>=|\+=|\?=|</|[=:+,;(){}\[\]<>])"
    r"|(?P<newline>\n)|(?P<other>[^\s=:+,;(){}\[\]<>\"'`]+|\S)",
    re.S,
)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
ELEMENT = re.compile(r"([^<>\n]+)</")
ASSIGNING = {"=", ":=", "=>", ":", "+=", "?="}
JOINING = {"+", "(", "["}
DEFINING = {"define", "set", "setenv", "const", "export"}


def name_weight(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    if not words:
        return 0.0
    weight = max([WORD_WEIGHTS.get(w.removesuffix("s") if w not in ("pass", "credentials") else w, 0.0) for w in words])
    if any(b in ("key", "keys") and a in KEY_WORDS for a, b in pairwise(words)):
        weight = 1.0
    return weight * (0.2 if words[-1] in HARMLESS_ENDS or "public" in words else 1.0)


def strength(length: int, characters: int) -> float:
    """How much a value looks like a secret: its length, how many different characters (a bit set) and classes it has."""
    if length < 6 or not characters:
        return 0.0
    lower, upper, digit = (characters >> ord(a) & (1 << n) - 1 for a, n in (("a", 26), ("A", 26), ("0", 10)))
    rest = characters & ~(lower << ord("a") | upper << ord("A") | digit << ord("0"))
    classes = sum(bool(c) for c in (lower, upper, digit, rest))
    value = 0.4 * min(1.0, length / 16) + 0.4 * min(1.0, log2(characters.bit_count()) / 4) + 0.2 * (classes > 1)
    return value if digit or classes > 2 else value / 2


def character_set(text: str) -> int:
    found = 0
    for c in set(text):
        found |= 1 << min(ord(c), 127)
    return found


class Reader:
    """Assignments of one text: targets with their terms, each a literal or a reference to another name."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup if m.lastgroup != "pass" else "url", m.start(), m.end()) for m in TOKEN.finditer(text)]
        self.targets: list[tuple[str, int]] = []
        self.literals: list[list[tuple[int, int]]] = []
        self.references: list[list[tuple[str, int]]] = []
        k = 0
        while k < len(self.tokens):
            k = max(k + 1, self.step(k))

    def word(self, k: int) -> str:
        return self.text[self.tokens[k][1] : self.tokens[k][2]] if 0 <= k < len(self.tokens) else ""

    def kind(self, k: int) -> str:
        return self.tokens[k][0] if 0 <= k < len(self.tokens) else "newline"

    def inside(self, k: int) -> tuple[int, int]:
        """Span of what a string token holds."""
        _, start, end = self.tokens[k]
        while self.text[start] not in "\"'`":
            start += 1
        quote = 3 if end - start >= 6 and self.text.startswith('"""', start) else 1
        return start + quote, end - quote

    def add(self, name: str, at: int, literals: list, references: list) -> None:
        if name and (literals or references):
            self.targets.append((name, at))
            self.literals.append([span for span in literals if self.usable(span)])
            self.references.append(references)

    def usable(self, span: tuple[int, int]) -> bool:
        value = self.text[span[0] : span[1]]
        return bool(value) and not any(c.isspace() for c in value) and not PLACEHOLDER.search(value) and not SETTING.fullmatch(value)

    def step(self, k: int) -> int:
        """Read what starts at token ``k``; the next token to look at."""
        kind, start, end = self.tokens[k]
        if kind == "url":
            found = TOKEN.match(self.text, start)
            self.add("url.password", start, [found.span("pass")], [])
            return k + 1
        if kind not in ("name", "string"):
            return k + 1
        name = self.text[slice(*self.inside(k))] if kind == "string" else self.word(k)
        after = self.word(k + 1)
        if after == ":" and self.kind(k + 2) == "name" and self.word(k + 3) == "=":
            return self.assigned(name, start, k + 3)  # a type between name and value
        if after in ASSIGNING:
            return self.assigned(name, start, k + 1)
        if kind == "string":
            if after == "," and self.kind(k + 2) == "string" and self.word(k - 1) in ("(", "{", "["):
                self.add(name, start, [self.inside(k + 2)], [])
            return k + 1
        if after == "(" and self.kind(k + 2) == "string" and self.word(k + 3) == ")":
            self.add(name, start, [self.inside(k + 2)], [])
        elif after == ">" and self.word(k - 1) == "<":
            body = ELEMENT.match(self.text, self.tokens[k + 1][2])
            if body:
                self.add(name, start, [body.span(1)], [])
        elif self.kind(k - 1) == "flag" or self.word(k - 1).lstrip("#") in DEFINING:
            return self.assigned(name, start, k)
        return k + 1

    def assigned(self, name: str, at: int, k: int) -> int:
        """Terms after token ``k``, joined by ``+``, brackets or side by side; what is not quoted is a name or a bare value."""
        literals, references, more, depth = [], [], True, 0
        first = k = k + 1
        while k < len(self.tokens):
            kind, start, end = self.tokens[k]
            if kind == "string":
                literals.append(self.inside(k))
                more = False
            elif kind == "ref":
                references.append((self.text[start:end].strip("${}% "), start))
                more = False
            elif kind == "op" and self.word(k) in JOINING:
                depth += self.word(k) != "+"
                more = True
            elif kind == "newline" and ((more and k > first) or depth):
                pass
            elif kind in ("name", "other", "url", "flag") and more:
                if self.word(k + 1) in ("(", "[") and kind == "name":
                    more = True
                else:
                    bare = BARE.match(self.text, start)
                    stop = bare.end() if bare else end
                    if kind == "name" and (depth or k > first or stop == end):
                        references.append((self.text[start:end], start))
                    if k == first and not depth and not PLAIN_NAME.fullmatch(self.text, start, stop):
                        literals.append((start, stop))
                    while k + 1 < len(self.tokens) and self.tokens[k + 1][1] < stop:
                        k += 1
                    more = False
            elif kind == "op" and self.word(k) in (",", ")", "]") and depth:
                depth -= self.word(k) != ","
                more = self.word(k) == ","
            else:
                break
            k += 1
        self.add(name, at, literals, references)
        if name == "value" and len(self.targets) > 1 and self.targets[-2][0] in ("key", "name") and self.literals[-2]:
            named, label = self.targets[-2][1], self.literals[-2][0]
            if "\n" not in self.text[named:at]:
                self.add(self.text[label[0] : label[1]], at, literals, references)
        return first

    def scored(self) -> list[tuple[int, int, str, float]]:
        """(start, end, name, score) of each literal that reaches a sensitive name."""
        known: dict[str, list[tuple[int, int]]] = {}
        for i, (name, at) in enumerate(self.targets):
            known.setdefault(name, []).append((at, i))
        used = [[d for name, at in refs for d in self.definition(known.get(name), at, i)] for i, refs in enumerate(self.references)]
        # a word that names a constant of the text is no literal
        literals = [[s for s in spans if self.text[s[0] : s[1]] not in known or self.quoted(s)] for spans in self.literals]
        values = self.values(literals, used)
        own = [name_weight(name) * strength(*values[i]) for i, (name, _) in enumerate(self.targets)]
        found: dict[tuple[int, int], tuple[float, str]] = {}
        seen: set[int] = set()
        for i in sorted(range(len(own)), key=lambda i: -own[i]):
            if own[i] < LEAST_SCORE:
                break
            waiting = [i]
            while waiting:
                j = waiting.pop()
                if j in seen:
                    continue
                seen.add(j)
                for span in literals[j]:
                    found.setdefault(span, (own[i], self.targets[i][0]))
                waiting += used[j]
        return sorted((s, e, name, score) for (s, e), (score, name) in found.items())

    def quoted(self, span: tuple[int, int]) -> bool:
        return span[0] > 0 and self.text[span[0] - 1] in "\"'`"

    @staticmethod
    def definition(places: list[tuple[int, int]] | None, at: int, own: int) -> list[int]:
        """The last assignment before a place, or else the last one of all; never the one that asks."""
        places = [p for p in places if p[1] != own] if places and len(places) < 3 else places
        if not places:
            return []
        k = bisect_left(places, (at, -1)) - 1
        found = places[k][1]
        if found == own:
            found = places[k - 1][1] if k > 0 else places[-1][1]
        return [] if found == own else [found]

    def values(self, literals: list, used: list) -> list[tuple[int, int]]:
        """Length and character set of each assignment's whole value, constants followed; a circle adds nothing."""
        done: list[tuple[int, int] | None] = [None] * len(literals)
        for root in range(len(literals)):
            stack, open_ = [(root, iter(used[root]))], {root}
            while done[root] is None:
                i, rest = stack[-1]
                ahead = next((j for j in rest if done[j] is None and j not in open_), None)
                if ahead is not None:
                    open_.add(ahead)
                    stack.append((ahead, iter(used[ahead])))
                    continue
                stack.pop()
                open_.discard(i)
                length = sum(e - s for s, e in literals[i])
                characters = 0
                for s, e in literals[i]:
                    characters |= character_set(self.text[s:e])
                for j in used[i]:
                    if done[j] is not None:
                        length, characters = length + done[j][0], characters | done[j][1]
                done[i] = (min(length, 1 << 30), characters)
        return done


def base_spans(text: str, low: str) -> list[tuple[int, int, str, float]]:
    """Spans of the three plain patterns, long enough ones only."""
    found = [(*m.span(), "hex", 1.0) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(*m.span(), "access", 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if any(s in low for s in STEMS):
        found += [(*m.span(), "assign", 1.0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    return found


def text_spans(text: str) -> list[tuple[int, int, str, float, str | None]]:
    """(start, end, kind, score, name) of all spans, by start, then kind."""
    low = text.lower()
    found = [(*span, None) for span in base_spans(text, low)]
    # no sensitive name without one of its words, so nothing is lost here
    if any(w in low for w in WORD_WEIGHTS) or "://" in text:
        found += [(s, e, "literal", score, name) for s, e, name, score in Reader(text).scored()]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ``found``, an array of structs kind, start, end, name, score.

    Places are code points of the whole text, ends exclusive. Kinds ``assign``, ``access`` and ``hex`` are the plain
    patterns; ``literal`` is what the lexer adds, with the target name and a score from 0.45 to 1. Literals with
    white space and placeholders are no secrets. Null and empty texts have none; null and repeated ids stay.
    Nothing is shuffled.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in small_batches(batches, "text"):
            rows = [
                [{"kind": kind, "start": s, "end": e, "name": name, "score": score} for s, e, kind, score, name in text_spans(text)]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.list_(span))], ["doc_id", "found"])

    schema = "doc_id long, found array<struct<kind: string, start: long, end: long, name: string, score: double>>"
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start, end, name, score."""
    return scan(docs, id_col, text_col).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def secret_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal, score.

    ``spans`` lists kind:start:end of all spans by start and kind, comma-joined; ``base_sha256`` hashes the list of
    the plain patterns alone (of the empty string where there is none); ``score`` is the highest, 0 without a span.
    """
    found = F.col("found")

    def counted(kind: str):
        return F.size(F.filter(found, lambda f: f.kind == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f.kind, f.start.cast("string"), f.end.cast("string"))), ",")

    base = F.sha2(listed(F.filter(found, lambda f: f.kind != "literal")), 256).alias("base_sha256")
    score = F.coalesce(F.array_max(F.transform(found, lambda f: f.score)), F.lit(0.0)).alias("score")
    return scan(docs, id_col, text_col).select("doc_id", *map(counted, KINDS[:3]), base, listed(found).alias("spans"), counted("literal"), score)
