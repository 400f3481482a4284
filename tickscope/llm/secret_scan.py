"""Secrets in texts: three fixed patterns and an assignment-aware lexer.

The lexer reads source and configuration syntax as (name, literal) pairs: ``name = "literal"``, ``name: 'literal'``,
``name => "literal"``, ``export NAME=literal``, ``"name": "literal"``. A statement goes on over a line end behind a sign of
assignment or ``+``, inside round and square brackets, behind a backslash, and before a line that begins with ``+`` or a sign of
assignment; comments at such line ends are read by themselves. Elements of a list are literals of their own. Bare values are read on
the sign's own line (or behind a backslash). Names bound to one literal are constants and are propagated
through ``other = NAME`` and concatenations ``a + "b"``, of any number of pieces. A literal is scored by its target's name, split into words at
underscores, dashes, dots and case changes, and by its own shape.

Defined cases: a null text is an empty one, without secrets; repeated rows give repeated rows; offsets count code points, ends
are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.arrow import with_columns

# The base kinds in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as [0-9a-f]+ finds them, of 24 or more

#: Words of a target's name and what they add; two words that stand together count as one name.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3,
             "credentials": 3, "api key": 3, "access key": 3, "private key": 3, "secret key": 3, "signing key": 3,
             "encryption key": 3, "client secret": 3, "auth": 2, "bearer": 2, "pass": 2, "key": 1}
#: Values that stand for a secret to be filled in.
PLACEHOLDERS = {"password", "passwd", "changeme", "secret", "token", "example", "none", "null", "true", "false", "undefined"}
THRESHOLD = 4
#: First characters that tell a placeholder: one more than the longest has.
HEAD = max(map(len, PLACEHOLDERS)) + 1

HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
SIGNS = ("=", ":", ":=", "=>", "+=")
TOKEN = re.compile(r"""
    (?P<joined>\\\r?\n)
  | (?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<op>=>|:=|[=!<>]=|\+=|[=:+])
  | (?P<name>[A-Za-z_][\w.$-]*)
  | (?P<break>[\n;,{}()\[\]])
  | (?P<other>[^\s])""", re.VERBOSE | re.ASCII)
SIGN = re.compile("[=:]")
#: Strings over several lines.
LONG = re.compile(r"""(?P<quote>\"{3}|'{3})(?:[^\\]|\\[\s\S])*?(?P=quote)|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'""")
JOINED = re.compile(r"\\\r?\n")
COMMENT = re.compile(r"#|//(?=\s)")
PLUS_BELOW = re.compile(r"[^\n]*\n[^\S\n]*\+(?!=)")
BARE = re.compile(r"[^\s\"'#;,]+")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> int:
    words = [w.lower() for w in WORDS.findall(name)]
    both = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return max([SENSITIVE.get(w, 0) for w in words + both], default=0)


class Shape:
    """What the score of a value depends on; of a concatenation, from the shapes of its pieces, as ``a = a + a`` doubles the value."""

    __slots__ = ("length", "counts", "head", "last", "broken")

    def __init__(self, value: str = ""):
        self.length, self.counts, self.head, self.last = len(value), Counter(value), value[:HEAD], value[-1:]
        self.broken = bool(re.search(r"\s|\$\{|\{\{", value))

    def add(self, other: "Shape") -> None:
        self.broken |= other.broken or self.last + other.head[:1] in ("${", "{{")
        self.length += other.length
        self.counts.update(other.counts)
        while self.length >> 62:
            # only proportions matter: halved together, they stay the same up to rounding
            self.counts = Counter({c: max(1, n >> 1) for c, n in self.counts.items()})
            self.length = sum(self.counts.values())
        self.head, self.last = (self.head + other.head)[:HEAD], other.last or self.last

    def score(self) -> int:
        if self.length < 6 or self.length < HEAD and self.head.lower() in PLACEHOLDERS or self.broken or len(self.counts) < 4:
            return 0
        if self.head[0] == "<" and self.last == ">":
            return 0
        letters = "".join(self.counts)
        mixture = sum(bool(re.search(p, letters)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        entropy = -sum(n / self.length * math.log2(n / self.length) for n in self.counts.values())
        return 1 + (mixture >= 2) + (entropy >= 3)


def literal_score(value: str) -> int:
    """0 for no secret, up to 3: length, mixture of characters and entropy."""
    return Shape(value).score()


class Parts:
    """A value as literals (value, start, end) and the values of constants, as these were when it was bound."""

    __slots__ = ("items", "shape")

    def __init__(self, items: list):
        self.items, self.shape = items, None

    def shaped(self) -> Shape:
        """The shape, from those of the constants below; each value is shaped once."""
        todo = [self]
        while todo:
            now = todo[-1]
            below = [x for x in now.items if isinstance(x, Parts) and x.shape is None]
            if now.shape is None and below:
                todo += below
                continue
            todo.pop()
            if now.shape is None:
                shape = Shape()
                for x in now.items:
                    shape.add(x.shape if isinstance(x, Parts) else Shape(x[0]))
                now.shape = shape
        return self.shape


Token = tuple[str, str, int, int]


class _Tokens:
    """Tokens of a text with a look ahead; a line end behind a backslash is none."""

    def __init__(self, text: str, start: int, stop: int, comments: list[tuple[int, int]] | None):
        self.text, self.stop, self.end = text, stop, ("end", "", stop, stop)
        self.comments = comments  # those skipped inside a statement; None inside a comment, where none is skipped
        self.known = -1  # a sign up to which no jump is of use
        self.seek(start)

    def seek(self, at: int) -> None:
        self.found, self.ahead = TOKEN.finditer(self.text, at, self.stop), deque()

    def peek(self, k: int = 0) -> Token:
        while len(self.ahead) <= k:
            m = next(self.found, None)
            if m is None:
                return self.end
            if m.lastgroup != "joined":
                self.ahead.append((m.lastgroup, m[0], m.start(), m.end()))
        return self.ahead[k]

    def pop(self) -> Token:
        out = self.peek()
        if self.ahead:
            self.ahead.popleft()
        return out

    def to_sign(self, at: int) -> None:
        """From the line start ``at`` to the next line with a sign, or the one before if the sign comes first."""
        if at <= self.known:
            return
        m = SIGN.search(self.text, at, self.stop)
        self.known = m.start() if m else self.stop
        start = self.text.rfind("\n", at, at + len(self.text[at:self.known].rstrip())) + 1 if m else self.known
        if start > at:
            self.seek(start)

    def sign(self, k: int) -> int:
        """Tokens up to and with the sign of assignment at ``k``, which may begin the next line; 0 for none."""
        if self.peek(k)[1] == "\n":
            k += 1
        t = self.peek(k)
        return k + 1 if t[0] == "op" and t[1] in SIGNS else 0

    def plus(self, k: int) -> bool:
        if self.peek(k)[1] == "\n":
            k += 1
        return self.peek(k)[:2] == ("op", "+")


#: (kind, value, start, end) with kind ``text``, ``bare`` or ``name``
Operand = tuple[str, str, int, int]


def assignments(text: str) -> Iterator[tuple[str, list[list[Operand]], list[list[Operand]]]]:
    """(target, elements, beginnings) of each statement: one list of operands, or several for a bracketed list; literals that follow
    each other only behind a backslash may also be words of a command, so the operands before are given as well."""
    return _statements(_Tokens(text, 0, len(text), []), 0)


def _statements(tokens: _Tokens, start: int) -> Iterator[tuple[str, list[list[Operand]], list[list[Operand]]]]:
    tokens.to_sign(start)
    while (t := tokens.peek()) is not tokens.end:
        if t[0] in ("name", "text") and (n := tokens.sign(1)):
            for _ in range(n):
                sign = tokens.pop()[1]
            elements, beginnings = _elements(tokens, sign, n > 2)
            if elements:
                yield t[1].strip("\"'"), elements, beginnings
            while tokens.comments:
                a, b = tokens.comments.pop()
                yield from _statements(_Tokens(tokens.text, a, b, None), a)
        else:
            tokens.pop()
            if t[1] == "\n":
                tokens.to_sign(t[3])


def _long(tokens: _Tokens, t: Token) -> tuple[Operand, int] | None:
    """A string over several lines, if it is one word, and its end."""
    quote, start = t[1][:1], t[2]
    if quote not in ("'", '"') or not (t[0] == "other" or t[1] == quote * 2 and tokens.text.startswith(quote, t[3])):
        return None
    m = LONG.match(tokens.text, start, tokens.stop)
    if m is None:
        return None
    width = 3 if m["quote"] else 1
    body = m[0][width:-width]
    value = JOINED.sub("", body).strip()
    if not value or re.search(r"\s", value):
        return None
    s = start + width + len(body) - len(body.lstrip())
    return ("text", value, s, s + len(body.strip())), m.end()


def _bare(text: str, at: int) -> tuple[list[Operand], int]:
    """The bare value at ``at``, in pieces where a backslash joins lines."""
    out = []
    while m := BARE.match(text, at):
        at = m.end()
        joined = JOINED.match(text, at - 1) if m[0][-1] == "\\" else None
        value = m[0][:-1] if joined else m[0]
        if value:
            out.append(("bare", value, m.start(), m.start() + len(value)))
        if not joined:
            break
        at = joined.end()
    return out, at


def _elements(tokens: _Tokens, sign: str, crossed: bool) -> tuple[list[list[Operand]], list[list[Operand]]]:
    """Operands behind a sign of assignment; what is no operand stays to be read."""
    text = tokens.text
    out: list[list[Operand]] = [[]]
    beginnings: list[list[Operand]] = []
    depth, wanted, dashed = 0, True, False
    while True:
        t = kind, value, s, e = tokens.peek()
        if value == "\n":
            item = tokens.peek(1)
            if dashed and not depth and not wanted and item[1] == "-" and text[item[3]:item[3] + 1].isspace():
                out.append([])
                wanted = True
            elif not (wanted or depth or tokens.plus(1)):
                break
            tokens.pop()
            crossed = True
        elif kind == "other" and tokens.comments is not None and COMMENT.match(text, s) and (wanted or depth or PLUS_BELOW.match(text, s)):
            line_end = text.find("\n", e)
            tokens.comments.append((s, line_end if line_end >= 0 else tokens.stop))
            tokens.seek(tokens.comments[-1][1])
        elif value == "-" and wanted and crossed and text[e:e + 1].isspace() and sign == ":":
            tokens.pop()
            dashed = True
        elif wanted and (found := _long(tokens, t)):
            out[-1].append(found[0])
            tokens.seek(found[1])
            wanted = False
        elif kind == "text":
            if (crossed or depth) and tokens.sign(1):
                break
            if not wanted:
                # in brackets or behind a backslash a literal directly behind another goes on with it
                before = out[-1][-1] if out[-1] else ("", "", s, s)
                if before[0] != "text" or not depth and not JOINED.search(text, before[3], s):
                    break
                if not depth:
                    beginnings.append(list(out[-1]))
            out[-1].append(("text", JOINED.sub("", value[1:-1]), s + 1, e - 1))
            tokens.pop()
            wanted = False
        elif kind == "op" and value == "+" and not wanted:
            tokens.pop()
            wanted = True
        elif kind == "break" and value in "([" and wanted:
            tokens.pop()
            depth += 1
        elif kind == "break" and value in ")]" and depth:
            tokens.pop()
            depth -= 1
            wanted = False
        elif kind == "break" and value == "," and depth:
            tokens.pop()
            out.append([])
            wanted = True
        elif kind == "name" and wanted and tokens.peek(1)[1] != "(":
            if (crossed or depth) and tokens.sign(1) or not out[-1] and tokens.peek(1)[:2] == ("op", "="):
                break  # name: type = literal, a = b = literal, or a key below a key: the next target decides
            if sign == "=" and not (crossed or depth or out[-1] or tokens.plus(1)):
                # export NAME=value: a bare value directly after the sign is a literal unless it is a known constant
                out[-1], end = _bare(text, s)
                tokens.seek(end)
                break
            out[-1].append(("name", value, s, e))
            tokens.pop()
            wanted = False
        else:
            if kind in ("other", "name") and not (crossed or depth or out[-1]) and sign in ("=", ":"):
                out[-1] = [("text", *x[1:]) for x in _bare(text, s)[0]]
            break
    return [x for x in out if x], beginnings


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Literals that reach a sensitive target, directly or through constants."""
    lowered = text.lower()
    if not any(h in lowered for h in HINTS) or not ("=" in text or ":" in text):
        return []
    constants: dict[str, Parts] = {}
    found: list[Parts] = []
    for target, elements, beginnings in assignments(text):
        score = name_score(target)
        for operands in beginnings + elements:
            digits = any(kind == "bare" and re.search("[0-9]", value) for kind, value, _, _ in operands)
            items: list[tuple[str, int, int] | Parts] = []
            for kind, value, s, e in operands:
                if kind == "text":
                    items.append((value, s, e))
                elif value in constants:
                    items.append(constants[value])
                elif kind == "bare" and digits:
                    items.append((value, s, e))
            parts = items[0] if len(items) == 1 and isinstance(items[0], Parts) else Parts(items)
            if score > 1 and (worth := parts.shaped().score()) and score + worth >= THRESHOLD:
                found.append(parts)
        constants[target] = parts if len(elements) == 1 else Parts([])
    spans, seen = set(), set()
    while found:
        parts = found.pop()
        if parts not in seen:
            seen.add(parts)
            found += [x for x in parts.items if isinstance(x, Parts)]
            spans |= {(x[1], x[2]) for x in parts.items if not isinstance(x, Parts) and x[2] > x[1]}
    return sorted(spans)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end)."""
    lowered = text.lower()
    out = []
    if any(s in lowered for s in STEMS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    counts = Counter(k for _, k, _ in base)
    listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
    every = sorted([*base, *((s, 3, e) for s, e in lexed_spans(text))])
    names = (*KINDS, "lexed")
    spans = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in every)
    return counts[0], counts[1], counts[2], hashlib.sha256(listed.encode()).hexdigest(), spans


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row; ``spans`` has the lexer's as kind ``lexed``.

    No shuffle: each text is scanned where it is read.
    """

    new = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}
    return with_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", new,
                        lambda texts: [list(c) for c in zip(*map(scan_text, texts))] or [[]] * len(new), keep=["doc_id"])
