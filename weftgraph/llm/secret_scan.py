"""Secret scan by assignment-aware lexing of source and configuration text.

Base spans (assign, access, hex) come from three fixed patterns. The method then goes through a text in three steps:
  1. a lexer goes from one structural character (operator, quote, bracket, comma, tag, line end, comment) to the next, so prose is passed in single
     matches; strings are single, double, back-quoted or triple-quoted, with escapes and letters before the quote; no token has a length limit;
  2. a parser of assignments: `name = value`, with a type (`name: str = value`), `name: value`, `:=`, `=>`, `+=`, `"name": value`, `x["name"] = value`,
     keyword arguments, tuples (`a, name = 1, value`), `define("name", value)` and its like, `<name a="b">value</name>` and CDATA, YAML block scalars. A
     value is a sum of strings (adjacent ones too), names, bare words, values in brackets, and calls, which hand on their last argument. What is
     commented out is parsed in the same way, with constants of its own;
  3. propagation: names assigned in an open scope (a bracket, or an indented block) are constants there and in scopes
     inside it; a value that names one takes its literals over, and literals are scored by the sensitive name they reach.
A pair's score adds the weight of the target name's words and the literal's shape (length, mixed alphabets, entropy) and
takes off for placeholders; from THRESHOLD on its literals are spans of kind `literal`, unless a base span covers them.

Cases: null and empty texts have no spans; very long texts are scanned whole; literals, names and sums have no limit;
a string that is not closed on its line is lexed as a mark alone; an unclosed comment or triple quote goes to the end of the
text; repeated rows each get a row; a null doc_id stays null; an empty table gives no rows; columns other than doc_id
and text are ignored. Starts and ends are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "literal"]
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so of [0-9a-f]+ those of 24 characters and more
_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)

#: Words of a target name and their weights; runs of two words count as one entry.
WEIGHTS = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "credential": 2.5, "credentials": 2.5,
    "token": 2.5, "apikey": 3.0, "api key": 3.0, "private key": 3.0, "access key": 3.0, "secret key": 3.0, "signing key": 3.0,
    "encryption key": 3.0, "auth": 1.5, "authorization": 2.0, "bearer": 2.5, "jwt": 2.5, "cookie": 1.5, "session key": 2.5,
    "connection string": 2.5, "dsn": 1.5, "salt": 1.5, "pin": 1.0, "key": 1.0,
}
#: The longest word of each entry: a text without any of them has no name of weight.
_SENSITIVE = re.compile("|".join(sorted({max(k.split(), key=len) for k in WEIGHTS})), re.IGNORECASE | re.ASCII)
#: Words after a name word that make it harmless (token_count, key_name, password_policy).
HARMLESS = {"count", "name", "length", "len", "policy", "type", "id", "hint", "field", "label", "file", "path", "url", "size", "limit", "index", "expiry", "ttl"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|changeme|example|placeholder|your.*|<.*>|\$\{.*\}|%.*%|todo|redacted|undefined)$")
THRESHOLD = 4.0

#: Runs are possessive: nothing after them could take back a part.
_TOKEN = re.compile(
    r'''(?P<triple>"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\Z)|\'\'\'(?:[^'\\]|\\.|'(?!\'\'))*+(?:\'\'\'|\Z))'''
    r'''|(?P<string>"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`]*+`)'''
    r"""|(?P<comment>/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)|<!--(?:[^-]|-(?!->))*+(?:-->|\Z)|(?<![^\s;{}])(?://|\#|--)[^\n]*+)"""
    r"""|(?P<line>\n[\x20\t]*+)"""
    r"""|<(?P<tag>[A-Za-z_][A-Za-z0-9_.\-]*+)>"""
    r"""|(?P<end></[A-Za-z_][A-Za-z0-9_.\-]*+>)"""
    r"""|(?P<op>:=|=>|==+|!=|<=|>=|[:=+])"""
    r"""|(?P<open>[(\[{])|(?P<close>[)\]}])"""
    r"""|(?P<name>[A-Za-z_$@%/][A-Za-z0-9_.$@%/~^&*!\#\-]*+)|(?P<bare>[A-Za-z0-9_.$@%/~^&*!\#\-]++)"""
    r"""|(?P<space>[\x20\t\r]++)|(?P<other>.)""",
    re.ASCII | re.DOTALL,
)
#: Bare values go on over = and + (base64 padding and the like) up to white space, quotes, brackets and separators.
_BARE = re.compile(r"""[A-Za-z0-9_+/.@$%!\#^&*~=\-]++(?:\{[^\s{}"']*+\})?""", re.ASCII)
_PLAIN_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*+", re.ASCII)


def name_weight(name: str) -> float:
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    best = 0.0
    for i, w in enumerate(words):
        two = f"{words[i - 1]} {w}" if i else ""
        weight = max(WEIGHTS.get(w, 0.0), WEIGHTS.get(two, 0.0))
        if weight and not (i + 1 < len(words) and words[-1] in HARMLESS):
            best = max(best, weight)
    return best


def _score(n: int, counts: Counter, harmless: bool) -> float:
    if n < 6 or harmless or " " in counts:
        return -4.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    chars = "".join(counts)
    kinds = sum(bool(re.search(p, chars)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, n / 16 if n < 16 else 1.0) + (kinds - 1) * 0.5 + (0.5 if entropy >= 3 else 0.0)


def literal_score(literal: str) -> float:
    return _score(len(literal), Counter(literal), bool(PLACEHOLDER.match(literal)))


class Value:
    """A literal at its place, or a sum of values. Sums share their parts, so a constant used often is held once.

    A sum's text may be far longer than the source; its score needs the length, counts of characters and both ends.
    """

    __slots__ = ("at", "counts", "end", "head", "n", "parts", "tail")

    def __init__(self, literal: str = "", at: int = 0, parts: tuple = ()):
        self.at, self.end, self.parts, self.counts = at, at + len(literal), parts, None
        self.n, self.head, self.tail = len(literal), literal, literal[-1:]
        if parts:
            self.counts, self.n = Counter(), sum(p.n for p in parts)
            self.head = ""
            for p in parts:
                self.counts.update(p.characters())
                self.head += p.head[:16] if len(self.head) < 16 else ""
                self.tail = p.tail or self.tail

    def characters(self) -> Counter:
        if self.counts is None:
            self.counts = Counter(self.head)
        return self.counts

    def score(self) -> float:
        if not self.parts:
            return literal_score(self.head)
        if self.n <= 16:
            return literal_score(self.head)
        head, chars = self.head.lower(), {c.lower() for c in self.counts}
        ends = any(head.startswith(a) and self.tail == b for a, b in (("<", ">"), ("${", "}"), ("%", "%")))
        return _score(self.n, self.counts, ends or head.startswith("your") or chars in ({"x"}, {"*"}, {"."}))


class Scopes:
    """Constants by name, innermost scope first. A scope opens with a bracket, or with a deeper indent, and ends with it."""

    def __init__(self):
        self.names: dict[str, list] = {}
        self.stack: list[tuple[int | None, list[str]]] = [(0, [])]

    def open(self, indent: int | None = None):
        self.stack.append((indent, []))

    def _leave(self):
        for name in self.stack.pop()[1]:
            self.names[name].pop()

    def close(self):
        """A closing bracket ends indented blocks inside it, and the bracket's scope; one that none opened ends nothing."""
        if any(i is None for i, _ in self.stack):
            while self.stack[-1][0] is not None:
                self._leave()
            self._leave()

    def line(self, indent: int):
        top = self.stack[-1][0]
        if top is None or indent == top:
            return
        if indent > top:
            return self.open(indent)
        while len(self.stack) > 1 and self.stack[-1][0] is not None and self.stack[-1][0] > indent:
            self._leave()

    def put(self, name: str, value: Value):
        own, held = self.stack[-1][1], self.names.setdefault(name, [])
        if held and held[-1][0] == len(self.stack):
            held[-1] = (len(self.stack), value)
        else:
            own.append(name)
            held.append((len(self.stack), value))

    def get(self, name: str) -> Value | None:
        held = self.names.get(name)
        return held[-1][1] if held else None


#: What the parser stops at; what stands between is prose or operands, and is passed in one match.
_NEXT = re.compile(r"""[=:<>,()\[\]{}"'`\n]|/\*|(?<![^\s;{}])(?://|\#|--)""")
_NAME_END = re.compile(r"[A-Za-z0-9_.\-]")
_INDENT = re.compile(r"\n[\x20\t]*+")
_COMMENT = re.compile(r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)|<!--(?:[^-]|-(?!->))*+(?:-->|\Z)|(?://|\#|--)[^\n]*+")
_TAG = re.compile(r"<([A-Za-z_][A-Za-z0-9_.\-]*+)(?=[\s>/])", re.ASCII)
_CDATA = re.compile(r"\s*+<!\[CDATA\[((?:[^\]]|\](?!\]>))*+)\]\]>\s*+")
_BLOCK = re.compile(r"[\x20\t]*+[|>](?:[+-]?[1-9]?|[1-9][+-])[\x20\t]*+(?:\#[^\n]*+)?\n")
_ROW = re.compile(r"([\x20\t]*+)([^\n]*+)(\n|\Z)")
#: A type after a name's colon, up to the = of its value: names, dots, brackets, unions.
_TYPE = re.compile(r"[\x20\t]*+(?:[A-Za-z_][A-Za-z0-9_.]*+(?:[<\[][^=:\n\"'`]*?[>\]]++(?=[\x20\t]*+[|=?!\[]))?+(?:\[\])*+[?!]?[\x20\t]*+\|?[\x20\t]*+)++=(?![=>])", re.ASCII)
#: Letters before a string's quote that belong to it.
_PREFIX = re.compile(r"""(?:[rRbBuUfF]{1,2}|[@$L]{1,2})(?=["'])""")
#: What stands between a value and another that may take its place.
_LINK = re.compile(r"(?:or|else)\b|\|\||\?\?|\?:|if\b(?:[^\n;\"'`()=]|==|(?<=[<>!])=)*?\belse\b")
#: Brackets, and strings whose brackets are none.
_PAREN = re.compile(r"""\"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`]*+`|[()]""", re.DOTALL)
#: Functions that give a value a name: name first, value second; and those whose lone argument names what they look up.
_SETTERS = {"define", "set", "put", "setenv", "putenv", "setproperty", "setitem", "setattribute", "setheader", "setdefault", "setvalue", "addheader", "header", "defvar", "setq"}
_GETTERS = re.compile(r"(?i)(?:get|getenv|env|environ|getproperty|getstring|lookup|fetch|config|setting|require|prompt|input|read)$")


class Parser:
    """Name-value pairs of a text, constants propagated in its order. base: the place in a larger text of which this is a comment."""

    def __init__(self, text: str, base: int = 0, comment: bool = False):
        self.text, self.base, self.comment, self.scopes, self.brackets, self.indent = text, base, comment, Scopes(), [], 0
        #: round brackets that close; up to where brackets are known to hold no literal and no constant
        self.closed: set[int] | None = None
        self.empty = 0

    def closes(self, at: int) -> bool:
        """Does the round bracket at a place close? Found out for all of the text at once."""
        if self.closed is None:
            self.closed, open_ = set(), []
            for m in _PAREN.finditer(self.text):
                if m.group() == "(":
                    open_.append(m.start())
                elif m.group() == ")" and open_:
                    self.closed.add(open_.pop())
        return at in self.closed

    def literal(self, text: str, at: int) -> Value:
        return Value(text, at + self.base)

    def skip(self, at: int, lines: bool = False) -> int:
        """Past blanks, and past line ends only where asked."""
        text, n, blank = self.text, len(self.text), " \t\r\n" if lines else " \t\r"
        while at < n and text[at] in blank:
            at += 1
        return at

    def name_before(self, at: int, low: int) -> tuple[str | None, int]:
        """The name that ends before a place (blanks between), from `low` on, and where it begins."""
        text, end = self.text, at
        while end > low and text[end - 1] in " \t":
            end -= 1
        start = end
        while start > low and _NAME_END.match(text, start - 1):
            start -= 1
        while start < end and not (text[start].isalpha() or text[start] == "_"):
            start += 1
        return (text[start:end] or None), start

    def put(self, name: str, value: Value | None):
        if value is not None:
            self.scopes.put(name, value)
            yield name, value

    def pairs(self):
        """Goes from one structural character to the next; `low` is where a name may begin at the earliest."""
        text, n, at, low = self.text, len(self.text), 0, 0
        key, key_end = None, -1  # a string that may be a key, and where an operator would have to follow
        targets: list[str] = []  # names before commas, of a tuple that may be assigned
        tags: list[str] = []
        while (m := _NEXT.search(text, at)) is not None:
            p, c = m.start(), m.group()
            if c == "\n":
                at = low = _INDENT.match(text, p).end()
                targets, key = [], None
                if not self.brackets and at < n and text[at] != "\n":
                    self.indent = at - p - 1
                    self.scopes.line(self.indent)
            elif c in "\"'`":
                t = _TOKEN.match(text, p)
                if t.lastgroup in ("string", "triple"):
                    at = low = t.end()
                    if t.lastgroup == "string":
                        key, key_end = t.group()[1:-1], self.skip(at)
                        if text[p - 1 : p] == "[" and text[key_end : key_end + 1] == "]":  # a subscript
                            key_end = self.skip(key_end + 1)
                else:
                    at = p + 1  # not closed: a mark alone
            elif c in ("/*", "//", "#", "--") or (c == "<" and text.startswith("<!--", p)):
                if self.comment:
                    at = low = p + len(c)
                    continue
                end = _COMMENT.match(text, p).end()
                begin = p + 4 if c == "<" else p + len(c)
                inner = Parser(text[begin:end], self.base + begin, True)  # what is commented out is read by itself
                yield from inner.pairs()
                at = low = end
            elif c in "=:":
                at, found = self.assignment(p, low, key if key_end == p else None, targets)
                for pair in found:
                    yield from self.put(*pair)
                low, targets, key = at, [], None
            elif c == ",":
                name, _ = self.name_before(p, low)
                if name and not self.brackets:
                    targets.append(name)
                else:
                    targets = []
                at = low = p + 1
            elif c == "<":
                t = _TAG.match(text, p)
                if t:
                    tags.append(t[1])
                    at = low = t.end()
                else:
                    if text.startswith("</", p) and tags:
                        tags.pop()
                    at = low = p + 1
                    at = max(at, text.find(">", p) + 1) if text.startswith("</", p) else at
                    low = at
            elif c == ">":
                at = low = p + 1
                if tags and text[p - 1] != "/":
                    value, at = self.content(at, tags[-1])
                    low = at
                    if value is not None:
                        yield from self.put(tags[-1], value)
                elif tags:
                    tags.pop()
            elif c in "([{":
                name = self.name_before(p, low)[0] if c == "(" else None
                self.brackets.append(c)
                self.scopes.open()
                at = low = p + 1
                if name and name.rsplit(".", 1)[-1].lower() in _SETTERS:
                    t = _TOKEN.match(text, self.skip(at, True)) if self.skip(at, True) < n else None
                    comma = self.skip(t.end(), True) if t and t.lastgroup == "string" else n
                    if text[comma : comma + 1] == ",":
                        value, end = self.value(self.skip(comma + 1, True), True)
                        if value is not None:
                            yield from self.put(t.group()[1:-1], value)
                            at = low = end
                targets = []
            else:  # a closing bracket
                if self.brackets:
                    self.brackets.pop()
                self.scopes.close()
                if not (c == "]" and key_end > p):
                    key = None
                at = low = p + 1
                targets = []

    def assignment(self, p: int, low: int, key: str | None, targets: list[str]) -> tuple[int, list]:
        """From an = or : at p: where to go on, and the (name, value) pairs."""
        text = self.text
        op = re.compile(r":=|=>|=++|:++").match(text, p)
        end, mark = op.end(), op.group()
        before = text[p - 1 : p]
        if mark not in ("=", ":", ":=", "=>") or (mark == "=" and before and before in "!<>"):
            return end, []
        at = p
        if mark == "=" and before and before in "+.-*|" and key is None:
            at = p - 1  # compound: the name stands before the sign
        name = key or self.name_before(at, low)[0]
        if not name:
            return end, []
        if mark == ":":
            value, to = self.block(end)
            if value is not None:
                return to, [(name, value)]
            typed = _TYPE.match(text, end)
            if typed and self.opens_literal(self.skip(typed.end())):
                end = typed.end()
        names = [*targets, name] if targets and mark == "=" else [name]
        out = []
        for i, own in enumerate(names):
            value, to = self.value(self.skip(end))
            if value is not None:
                if at < p and before == "+" and (old := self.scopes.get(own)) is not None:
                    value = Value(parts=(old, value))
                out.append((own, value))
            end = max(end, to)
            if i + 1 < len(names):
                end = self.skip(end)
                if text[end : end + 1] != ",":
                    break
                end += 1
        return end, out

    def opens_literal(self, at: int) -> bool:
        """Does a string, a bracket or a call begin here?"""
        return bool(re.compile(r"""["'`(\[]|[rRbBuUfF@$L]{1,2}["']|[A-Za-z_][A-Za-z0-9_.]*+\s*+(?:\(|\Z|[;\n])""").match(self.text, at))

    def content(self, at: int, tag: str) -> tuple[Value | None, int]:
        """What an element holds, if that is text or CDATA alone."""
        text = self.text
        data = _CDATA.match(text, at)
        if data and text.startswith(f"</{tag}", data.end()):
            return self.literal(data[1], data.start(1)), data.end()
        close = text.find("<", at)
        if close > at and text.startswith(f"</{tag}", close):
            inner = text[at:close]
            if inner.strip():
                return self.literal(inner.strip(), at + len(inner) - len(inner.lstrip())), close
        return None, at

    def block(self, at: int) -> tuple[Value | None, int]:
        """A YAML block scalar: lines indented deeper than the name, after | or > and its signs; each line's text is a part."""
        head = _BLOCK.match(self.text, at)
        if not head:
            return None, at
        at, parts = head.end(), []
        while at < len(self.text):
            m = _ROW.match(self.text, at)
            if m[2] and len(m[1]) <= self.indent:
                break
            if m[2].rstrip():
                parts.append(self.literal(m[2].rstrip(), m.start(2)))
            at = m.end()
        # the line end before the next line stays, so that its indent is seen
        return (parts[0] if len(parts) == 1 else Value(parts=tuple(parts))) if parts else None, at - (at > head.end() and self.text[at - 1] == "\n")

    def string(self, at: int) -> tuple[Value, int] | None:
        """A string, with letters before its quote, at a place."""
        own = _PREFIX.match(self.text, at)
        begin = own.end() if own else at
        if self.text[begin : begin + 1] not in tuple("\"'`"):
            return None
        m = _TOKEN.match(self.text, begin)
        if m.lastgroup == "string":
            return self.literal(m.group()[1:-1], begin + 1), m.end()
        if m.lastgroup == "triple":
            shut = 3 if len(m.group()) >= 6 and m.group()[-3:] == m.group()[:3] else 0
            return self.literal(m.group()[3 : len(m.group()) - shut], begin + 3), m.end()
        return None

    def value(self, begin: int, lines: bool = False) -> tuple[Value | None, int]:
        """A sum of strings, names, bare words, values in brackets and calls; None if there is none. lines: it may go on over line ends.

        Brackets and calls are kept on a stack, so their depth has no limit: [sum so far, place of its begin, name of the call, its arguments].
        """
        text, n, at = self.text, len(self.text), begin
        stack: list[list] = []
        parts: list[Value] = []
        while True:
            done = False
            at = self.skip(at, lines or bool(stack))
            found = self.string(at) if at < n else None
            if found:
                parts.append(found[0])
                at = found[1]
            elif at < n and text[at] == "(" and at >= self.empty and self.closes(at):
                stack.append([parts, None, []])
                parts, at = [], at + 1
                continue
            elif at < n and (bare := _BARE.match(text, at)):
                word, end = bare.group(), bare.end()
                named = _PLAIN_NAME.match(text, at)
                if word == "new" and _PLAIN_NAME.match(text, self.skip(end)):
                    at = end
                    continue
                if named and text[named.end() : named.end() + 1] == "(" and named.end() >= self.empty and self.closes(named.end()):
                    stack.append([parts, named.group(), []])
                    parts, at = [], named.end() + 1
                    continue
                known = self.scopes.get(word)
                plus = text.find("+", at, end)
                if known is not None:
                    parts.append(known)
                elif plus > at and self.scopes.get(word[: plus - at]) is not None:
                    parts.append(self.scopes.get(word[: plus - at]))  # name+"literal", written together
                    end = plus
                elif named and (text[self.skip(end) : self.skip(end) + 1] == "+" or _LINK.match(text, self.skip(end))) or parts or stack:
                    pass  # a name of a sum, or an argument, that is not known
                else:
                    parts.append(self.literal(word, at))
                at = end
            else:
                done = True
            # after an operand: a sign or another string goes on; a comma or a bracket ends an argument
            while True:
                nxt = self.skip(at, lines or bool(stack))
                c = text[nxt : nxt + 1]
                if stack and c and c in "),":
                    held = stack[-1]
                    held[2].append(self.summed(parts))
                    if c == ",":
                        parts, at, done = [], nxt + 1, False
                        break
                    stack.pop()
                    inner = self.of_call(held[1], held[2])
                    parts, at, done = held[0] + ([inner] if inner is not None else []), nxt + 1, False
                    continue
                if not done and c == "+" and text[nxt + 1 : nxt + 2] != "=":
                    at = nxt + 1
                    break
                if not done and (link := _LINK.match(text, nxt)):
                    at = link.end()
                    break
                if not done and parts and self.string(nxt):
                    at = nxt
                    break
                if stack and not done and c and c not in "]}":
                    at = nxt + 1  # another operator or word within brackets
                    break
                while stack:  # a bracket that is not closed: what was read so far
                    held = stack.pop()
                    inner = self.of_call(held[1], [*held[2], self.summed(parts)])
                    parts = held[0] + ([inner] if inner is not None else [])
                if not parts:
                    self.empty = max(self.empty, at)
                return self.summed(parts), at if parts else begin

    @staticmethod
    def summed(parts: list[Value]) -> Value | None:
        return None if not parts else parts[0] if len(parts) == 1 else Value(parts=tuple(parts))

    @staticmethod
    def of_call(name: str | None, arguments: list[Value | None]) -> Value | None:
        """What a call, or a bracket (no name), hands on: its last argument, such as a default; a look-up's lone argument names what it looks for."""
        if name is None:
            found = [a for a in arguments if a is not None]
            return Value(parts=tuple(found)) if len(found) > 1 else found[0] if found else None
        return None if len(arguments) == 1 and _GETTERS.search(name) else arguments[-1]


def pairs(text: str):
    """(name, value) for each assignment, constants propagated in the order of the text."""
    return Parser(text).pairs()


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans by start, then kind as listed in KINDS."""
    base: list[tuple[int, int, str]] = []
    if _NAMES.search(text):
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    more, told_of = set(), set()
    if _SENSITIVE.search(text) and ("=" in text or ":" in text or "</" in text or "(" in text):
        # base spans of one kind do not overlap, so of each kind only the last that begins by a place can cover it
        by_kind = [[s for s in base if s[2] == k] for k in KINDS[:3]]
        starts = [[s[0] for s in own] for own in by_kind]
        held = []  # keeps values alive while their ids stand for them
        for name, value in pairs(text):
            weight = name_weight(name)
            if weight and value.n >= 6 and weight + value.score() >= THRESHOLD:
                held.append(value)
                todo = [value]
                while todo:
                    v = todo.pop()
                    if id(v) in told_of:
                        continue
                    told_of.add(id(v))
                    todo += v.parts
                    if not v.parts and v.end > v.at:
                        last = [own[i - 1] for own, at in zip(by_kind, starts, strict=True) if (i := bisect_right(at, v.at))]
                        if not any(v.end <= s[1] for s in last):
                            more.add((v.at, v.end, "literal"))
    return sorted(base + list(more), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def told(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind>>) of each row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for b in batches:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


def join_spans(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:3]))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in KINDS], F.sha2(join_spans(base), 256).alias("base_sha256"), join_spans(F.col("spans")).alias("spans"))
