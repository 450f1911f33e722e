"""Lexers of source languages and the bracket tree over what they leave.

A language's lexer is an automaton: one pattern finds the next place that matters in code (comment,
string, here-document, bracket); strings that hold code (templates) push a state and come back to
it at the bracket that closes the code. What comes out is the text with comments and strings
blanked, place by place and line by line the same, so patterns over it can't see into either, and
brackets in it are real ones. The tree says which brackets enclose a place.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

_CLOSES = {"(": ")", "[": "]", "{": "}", "<": ">"}


@dataclass(frozen=True)
class Quoted:
    """A kind of string: what opens it, what closes it (``{1}`` stands for the opener's first group), what opens code inside it."""

    opens: str
    closes: str
    code: str | None = None  # its last character is the bracket that opens
    escapes: bool = True
    one_line: bool = True


@dataclass
class Lexicon:
    line_comment: str | None = r"//"
    block: tuple[str, str] | None = (r"/\*", r"\*/")
    nested: bool = False
    quoted: tuple[Quoted, ...] = ()
    whole: str | None = None  # literals that one pattern takes as a whole, like characters
    regex: bool = False  # whether /.../ may be a literal
    here: str | None = None  # opener of a here-document; group ``t`` is its last line, group ``c`` says it may be indented
    brackets: str = "()[]{}"
    code: re.Pattern = field(init=False)
    inside: list[re.Pattern | None] = field(init=False)

    def __post_init__(self) -> None:
        parts = [("comment", self.line_comment), ("block", self.block and self.block[0]), ("whole", self.whole), ("here", self.here), *((f"q{k}", q.opens) for k, q in enumerate(self.quoted)), ("slash", "/" if self.regex else None), ("newline", "\n" if self.here else None), ("bracket", r"[()\[\]{}]")]
        self.code = re.compile("|".join(f"(?P<{name}>{p})" for name, p in parts if p), re.M)
        self.inside = [None if "{1}" in q.closes else _inside(q, q.closes) for q in self.quoted]


def _inside(q: Quoted, closes: str) -> re.Pattern:
    parts = [r"(?P<escape>\\[\s\S])" if q.escapes else "", f"(?P<end>{closes})", f"(?P<code>{q.code})" if q.code else "", r"(?P<line>(?=\n))" if q.one_line else ""]
    return re.compile("|".join(p for p in parts if p))


_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%^~>\n]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|if|unless|when|and|or|not))[ \t]*\Z")
_PERCENT = {"(": r"\)", "[": r"\]", "{": r"\}", "<": ">"}


@dataclass
class Lexed:
    """``code``: the text with comments and strings blanked, each string between two quotation marks; spans of both in order."""

    text: str
    code: str
    comments: list[tuple[int, int]]
    strings: list[tuple[int, int]]

    def __post_init__(self) -> None:
        self.string_at = dict(self.strings)
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", self.text))]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.line_starts, at)


def lex(text: str, lexicon: Lexicon) -> Lexed:
    comments: list[tuple[int, int]] = []
    strings: list[tuple[int, int]] = []
    # A state: (pattern inside the string, where it began or None for a piece of an outer one, closing bracket of its code, depth of such brackets).
    states: list[list] = []
    heres: list[tuple[str, bool]] = []
    absent: set[tuple[str, bool]] = set()
    at, size, inside = 0, len(text), None
    began = 0
    while at < size:
        if inside is not None:  # in a string
            m = inside.search(text, at)
            if m is None:
                at = size
            elif m.lastgroup == "escape":
                at = m.end()
                continue
            elif m.lastgroup == "code":
                states.append([inside, began, m[0][-1], 0])
                inside, at = None, m.end()
                continue
            else:
                at = m.end()
            if not states:
                strings.append((began, at))
            inside = None
            continue
        m = lexicon.code.search(text, at)
        if m is None:
            break
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "bracket":
            if states:
                state = states[-1]
                if m[0] == state[2]:
                    state[3] += 1
                elif m[0] == _CLOSES[state[2]]:
                    state[3] -= 1
                    if state[3] < 0:
                        states.pop()
                        inside, began = state[0], state[1]
        elif kind == "comment":
            end = text.find("\n", at)
            at = size if end < 0 else end
            comments.append((start, at))
        elif kind == "block":
            at = _block_end(text, at, lexicon)
            comments.append((start, at))
        elif kind == "whole":
            if not states:
                strings.append((start, at))
        elif kind == "slash":
            if (found := _REGEX.match(text, start)) and _BEFORE_REGEX.search(text, max(0, start - 40), start):
                at = found.end()
                if not states:
                    strings.append((start, at))
        elif kind == "here":
            heres.append((m["t"], m["c"] is not None))
        elif kind == "newline":
            if heres:
                begin = at
                for here in heres:
                    end = None if here in absent else re.compile(rf"^[ \t]*{here[0]}\b" if here[1] else f"^{here[0]}$", re.M).search(text, at)
                    if end:
                        at = end.end()
                    else:
                        absent.add(here)  # without its last line it was none
                heres.clear()
                if not states and at > begin:
                    strings.append((begin, at))
        else:  # a string opens
            k = int(kind[1:])
            q = lexicon.quoted[k]
            inside = lexicon.inside[k]
            if inside is None:
                mark = re.match(q.opens, m[0])[1]
                inside = _inside(q, q.closes.replace("{1}", _PERCENT.get(mark, re.escape(mark))))
            began = start
    if inside is not None or states:
        strings.append((states[0][1] if states else began, size))
    blanked, done = [], 0
    for start, end, is_string in sorted([(*c, False) for c in comments if not _within(c, strings)] + [(*s, True) for s in strings]):
        if start < done:
            continue
        blank = re.sub(r"[^\n]", " ", text[start:end])
        if is_string and len(blank) > 1:
            blank = '"' + blank[1:-1] + ('"' if blank[-1] != "\n" else "\n")
        blanked += [text[done:start], blank]
        done = end
    return Lexed(text, "".join(blanked) + text[done:], [c for c in comments if not _within(c, strings)], strings)


def _within(span: tuple[int, int], spans: list[tuple[int, int]]) -> bool:
    """Whether a span lies in one of ``spans``, which are in order."""
    k = bisect.bisect_right(spans, (span[0], 1 << 62)) - 1
    return k >= 0 and span[0] < spans[k][1]


def _block_end(text: str, at: int, lexicon: Lexicon) -> int:
    opens, closes = lexicon.block
    edge, depth = re.compile(f"(?P<open>{opens})|(?P<close>{closes})", re.M), 1
    while m := edge.search(text, at):
        at = m.end()
        if m.lastgroup == "close":
            depth -= 1
            if not depth:
                return at
        elif lexicon.nested:
            depth += 1
    return len(text)


class Tree:
    """Brackets of lexed code: what encloses a place, and where a bracket closes. One that nothing closes reaches to the end; a stray closing one is passed over."""

    def __init__(self, code: str, brackets: str = "()[]{}"):
        self.code, self.size = code, len(code)
        self.opens: list[int] = []
        self.closes: list[int] = []
        self.parents: list[int] = []
        self._places, self._within = [0], [-1]  # from each place on, the innermost bracket
        stack: list[int] = []
        count = dict.fromkeys(")]}", 0)
        for m in re.compile(f"[{re.escape(brackets)}]").finditer(code):
            mark = m[0]
            if mark in _CLOSES:
                self.parents.append(stack[-1] if stack else -1)
                stack.append(len(self.opens))
                self.opens.append(m.start())
                self.closes.append(self.size)
                count[_CLOSES[mark]] += 1
                self._places.append(m.start() + 1)
            elif count[mark]:
                while True:
                    block = stack.pop()
                    own = _CLOSES[code[self.opens[block]]]
                    count[own] -= 1
                    self.closes[block] = m.start()
                    if own == mark:
                        break
                self._places.append(m.start())
            else:
                continue
            self._within.append(stack[-1] if stack else -1)

    def inner(self, at: int) -> int:
        """The innermost bracket around a place, -1 for none."""
        return self._within[bisect.bisect_right(self._places, at) - 1]

    def block_at(self, at: int) -> int:
        """The bracket that opens at a place."""
        k = bisect.bisect_left(self.opens, at)
        return k if k < len(self.opens) and self.opens[k] == at else -1

    _STEP = re.compile(r"[;()\[\]{}]")

    def body(self, at: int, limit: int, pairs: str = "{") -> int:
        """The first brace on the level of ``at`` before a semicolon, the level's end or ``limit``; -1 for none."""
        while (m := self._STEP.search(self.code, at)) and m.start() < limit:
            if m[0] in ";)]}":
                return -1
            block = self.block_at(m.start())
            if block < 0:
                at = m.end()
                continue
            if m[0] in pairs and not (self.code[m.end() : self.closes[block]].strip() == "" and re.search(r"\b(?:interface|struct)[ \t]*$", self.code[max(0, m.start() - 20) : m.start()])):
                return block
            at = self.closes[block] + 1
        return -1


_DOUBLE, _SINGLE = Quoted('"', '"'), Quoted("'", "'")
_C_CHAR = r"'(?:\\[^\n]|[^'\\\n])[^'\n]{0,8}?'"
LEXICONS: dict[str, Lexicon] = {
    "python": Lexicon(r"\#", None, quoted=tuple(Quoted(rf"(?:\b[rRbBfFuU]{{1,2}})?{q}", q, one_line=len(q) == 1) for q in ('"""', "'''", '"', "'"))),
    "javascript": Lexicon(quoted=(_DOUBLE, _SINGLE, Quoted("`", "`", r"\$\{", one_line=False)), regex=True),
    "go": Lexicon(quoted=(_DOUBLE, Quoted("`", "`", escapes=False, one_line=False)), whole=_C_CHAR),
    "rust": Lexicon(nested=True, quoted=(Quoted(r'\bb?r(\#*)"', '"{1}', escapes=False, one_line=False), Quoted('"', '"', one_line=False)), whole=r"'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}'\n]*\}|[^\n])|[^'\\\n])'"),
    "ruby": Lexicon(r"\#", (r"^=begin\b", r"^=end\b[^\n]*"), quoted=(Quoted('"', '"', r"\#\{", one_line=False), Quoted("'", "'", one_line=False), Quoted("`", "`", r"\#\{"), Quoted(r"%[qQwWiIrx]?([(\[{<|!])", "{1}", one_line=False)), regex=True, here=r"""<<(?P<c>[~-])?(?P<hq>["'`]?)(?P<t>[A-Z_]\w*)(?P=hq)"""),
    "bash": Lexicon(r"(?:^|(?<=[\s;(&|]))\#", None, quoted=(Quoted(r"\$'", "'", one_line=False), Quoted("'", "'", escapes=False, one_line=False), Quoted('"', '"', r"\$\(", one_line=False)), whole=r"\\.|\$\{[^}\n]*\}|\$\#", here=r"""(?<!<)<<(?P<c>-)?[ ]*(?P<hq>["']?)(?P<t>[A-Za-z_]\w*)(?P=hq)""", brackets="{}"),
    "java": Lexicon(quoted=(Quoted('"""', '"""', one_line=False), _DOUBLE), whole=_C_CHAR),
    "csharp": Lexicon(quoted=(Quoted('"""+', '"""+', escapes=False, one_line=False), Quoted(r'(?:\$@|@\$?)"', '"(?!")', escapes=False, one_line=False), Quoted(r'\$"', '"', r"(?<!\{)\{(?!\{)"), _DOUBLE), whole=_C_CHAR),
    "php": Lexicon(r"//|\#(?!\[)", quoted=(Quoted('"', '"', one_line=False), Quoted("'", "'", one_line=False)), here=r"""<<<(?P<c>)[ ]*(?P<hq>["']?)(?P<t>[A-Za-z_]\w*)(?P=hq)"""),
    "kotlin": Lexicon(nested=True, quoted=(Quoted('"""', '"""', r"\$\{", escapes=False, one_line=False), Quoted('"', '"', r"\$\{")), whole=_C_CHAR),
    "swift": Lexicon(nested=True, quoted=(Quoted('(\\#+)"', '"{1}', escapes=False, one_line=False), Quoted('"""', '"""', r"\\\(", one_line=False), Quoted('"', '"', r"\\\("))),
    "elixir": Lexicon(r"\#", None, quoted=(Quoted('"""', '"""', r"\#\{", one_line=False), Quoted("'''", "'''", one_line=False), Quoted('"', '"', r"\#\{", one_line=False), Quoted("'", "'", one_line=False), Quoted(r"~[a-zA-Z]([(\[{<|/\"])", "{1}", one_line=False)), whole=r"\?\\?[^\s]"),
}
LEXICONS["typescript"] = LEXICONS["javascript"]
