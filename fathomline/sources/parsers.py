"""Symbols, imports and exports of source files, for thirteen languages.

A file is lexed first, so that neither strings nor comments can look like code, and its brackets (or
``end`` words, or indentation) form a tree. Each language is a table of patterns for declarations;
one is listed if nothing around it is a function's body or another opaque one (interfaces, types and traits of
some languages, values), and its parent is the nearest container (class, implementation) around it, or for
five languages the last one before it. Doc comments are those right before a declaration; Python's are the
first statement of a body. Imports count wherever they stand in code. Constructors aren't listed.

Files are parsed where they lie, Arrow batch by batch, without a shuffle.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexer import LEXICONS, Lexed, Tree, lex

SYMBOL = "struct<name:string,kind:string,file:string,line:long,signature:string,visibility:string,docstring:string,parent:string>"
_NOT_NAMES = frozenset("if else for while switch catch return new do try with function constructor super throw await match when using lock foreach elseif".split())


@dataclass
class Language:
    """``symbols``: (kind, pattern whose group ``n`` is the name, at a statement's begin).

    A kind that ends in ``!`` is a container, in ``~`` has an opaque body; functions and methods have one, too.
    """

    symbols: list[tuple[str, str]]
    imports: list[str]
    private: Callable[[str, str, str], bool]  # of a name, its kind and the rest of its line
    clean: Callable[[str], str | None] = lambda x: x
    scope: str = "brace"  # how bodies end: indent, brace, end (words), or file for containers that last until the next one
    doc: str | None = None  # pattern of a line of a doc comment
    exported: Callable[[str, str, str], bool] = lambda n, kind, line: kind != "method"  # among those that aren't private
    methods: bool = True  # whether a function of a container is a method
    members: str = ""  # what follows the parentheses of a method
    compiled: list[tuple[str, re.Pattern]] = field(default_factory=list)
    sources: list[re.Pattern] = field(default_factory=list)

    def __post_init__(self) -> None:
        begin = "^[ \\t]*" if self.scope == "indent" else r"(?:^|(?<=[;{}]))[ \t]*"
        self.compiled = [(k, re.compile(begin + p, re.M)) for k, p in self.symbols]
        self.sources = [re.compile(p, re.M) for p in self.imports]


def _local(x: str) -> str | None:
    """Relative or scoped paths only, without leading ./ and ../."""
    if not (x.startswith(".") or "/" in x):
        return None
    return re.sub(r"^(\.\./)+", "", re.sub(r"^(\./)+", "", x)) or None


def _crate(x: str) -> list[str]:
    """Paths below the crate or the parent module, a group's one by one; names after ``as`` go."""
    x = re.sub(r"\s+as\s+\w+", "", x)
    x = re.sub(r"\s+", "", x)

    def grown(prefix: str, rest: str) -> list[str]:
        opens = rest.find("{")
        if opens < 0:
            return [f"{prefix}{rest}"]
        depth, begin, out = 0, opens + 1, []
        for i in range(opens, len(rest)):
            depth += (rest[i] == "{") - (rest[i] == "}")
            if depth == 1 and rest[i] == "," or depth == 0:
                if rest[begin:i]:
                    out += grown(prefix + rest[:opens], rest[begin:i])
                begin = i + 1
            if depth == 0:
                break
        return out

    return [p.removesuffix("::self").replace("::", "/") for p in grown("", x)] if x.startswith(("crate::", "super::")) else []


def _shell(x: str) -> str | None:
    """Without variables and command substitutions at the front; nested parentheses are balanced."""
    x = x.strip("\"'")
    while True:
        if x.startswith("$("):
            depth = 0
            for i, c in enumerate(x):
                depth += (c == "(") - (c == ")")
                if c == ")" and not depth:
                    x = x[i + 1 :].lstrip("/")
                    break
            else:
                return None
        elif m := re.match(r"\$\{[^}]*\}/?|\$\w+/?", x):
            x = x[m.end() :]
        else:
            return x or None


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|readonly|open|data|inline|suspend|fileprivate|mutating|class|unsafe|extern|synchronized|native|default|strictfp|transient|volatile|enum|inner|value|companion)\s+)*"
_NOTES = r"(?:@(?!interface\b)[\w.]+(?:\([^()]*\))?\s*)*"
_JS = Language(
    [("class!", r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(?P<n>[\w$]+)"), ("interface~", r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+(?P<n>[\w$]+)"), ("type~", r"(?:export\s+)?(?:declare\s+)?type\s+(?P<n>[\w$]+)\s*[=<]"), ("enum~", r"(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<n>[\w$]+)"),
     ("function", r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\b\s*\*?\s*(?P<n>[\w$]+)"), ("const~", r"(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s+(?!enum\b)(?P<n>[\w$]+|[{\[])"),
     ("method", r"(?:(?:public|private|protected|static|async|readonly|get|set|override|abstract)\s+)*[*#]?\s*(?P<n>[\w$]+)\s*(?:<[^>()]*>)?\s*(?=\()")],
    [r"""\bfrom\s*['"]([^'"\n]+)['"]""", r"""^\s*import\s+['"]([^'"\n]+)['"]""", r"""\brequire\(\s*['"]([^'"\n]+)['"]"""],
    lambda n, kind, line: kind != "method" and not line.startswith("export"),
    _local, doc=r"/\*\*(?!/)", members=r"\s*(?::[^;{}]*)?\{",
)
_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
LANGUAGES: dict[str, Language] = {
    "python": Language(
        [("class!", r"class\s+(?P<n>\w+)"), ("function", r"(?:async\s+)?def\s+(?P<n>\w+)"), ("const", r"(?P<n>[A-Z_][A-Z0-9_]*)\s*(?::[^=\n]+)?=(?!=)")],
        [r"^[ \t]*from\s+([.\w]+)\s+import\b", r"^[ \t]*import\s+([\w., \t]+)"],
        lambda n, kind, line: kind == "function" and n.startswith("_") and not n.startswith("__") or kind == "method" and n.startswith("_") and not n.startswith("__"),
        lambda x: x.split(" as ")[0].strip().lstrip(".").replace(".", "/") or None, "indent",
    ),
    "typescript": _JS,
    "javascript": _JS,
    "go": Language(
        [("method", r"func\s*\(\s*(?:\w+\s+)?\*?\s*(?P<p>\w+)[^)]*\)\s*(?P<n>\w+)"), ("function", r"func\s+(?P<n>\w+)"), ("struct~", r"(?:type\s+)?(?P<n>\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface~", r"(?:type\s+)?(?P<n>\w+)(?:\[[^\]]*\])?\s+interface\b"), ("type~", r"(?:type\s+)?(?P<n>\w+)\b(?:\[[^\]]*\])?\s*(?=[\w*\[\](=])"), ("const~", r"(?:(?:const|var)\s+)?(?P<n>\w+)")],
        [r'^[ \t]*import\s+(?:[\w.]+\s+)?"([^"\n]+)"', r'^[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"[ \t]*$'],
        lambda n, kind, line: not n[:1].isupper(), lambda x: x.rpartition("/")[2], doc=r"//",
        exported=lambda n, kind, line: kind != "method",
    ),
    "rust": Language(
        [("impl!", r"(?:unsafe\s+)?impl\b(?:\s*<[^{;]*?>(?=\s))?\s+(?:[^{;]*?\bfor\s+)?(?:&\s*)?(?P<n>[\w:]+)"), ("trait~", _PUB + r"(?:unsafe\s+)?(?:auto\s+)?trait\s+(?P<n>\w+)"), ("struct~", _PUB + r"struct\s+(?P<n>\w+)"), ("enum~", _PUB + r"enum\s+(?P<n>\w+)"), ("type~", _PUB + r"type\s+(?P<n>\w+)"), ("const~", _PUB + r"(?:const|static)\s+(?:mut\s+)?(?P<n>[A-Z_]\w*)\s*:"), ("function", _PUB + r"(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+(?:\"[^\"]*\"\s+)?)?fn\s+(?P<n>\w+)"), ("macro~", r"macro_rules!\s*(?P<n>\w+)")],
        [r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(mod\s+\w+)\s*;"],
        lambda n, kind, line: not line.startswith("pub"), lambda x: [x[3:].strip()] if re.match(r"mod\s", x) else _crate(x), doc=r"///(?!/)",
    ),
    "ruby": Language([("class!", r"(?:class|module)\s+(?P<n>[A-Z][\w:]*)"), ("function", r"(?:private\s+|public\s+|protected\s+|private_class_method\s+)?def\s+(?:self\.)?(?P<n>\w+[?!=]?)")], [r"""^[ \t]*require(?:_relative)?[ \t(]+['"]([^'"\n]+)['"]"""], lambda n, kind, line: kind != "class" and (n.startswith("_") or line.startswith("private")), scope="end", exported=lambda n, kind, line: not line.startswith("def self.")),
    "bash": Language([("function", r"function\s+(?P<n>[\w:.-]+)"), ("function", r"(?P<n>[\w:.-]+)\s*\(\)")], [r"(?:^|[;&|]|\bthen\b|\bdo\b)[ \t]*(?:source|\.)[ \t]+(\"[^\"\n]*\"|'[^'\n]*'|\$\([^)\n]*(?:\([^)\n]*\)[^)\n]*)*\)\S*|[^\s;&|]+)"], lambda n, kind, line: False, _shell),
    "java": Language([("class!", rf"{_NOTES}{_MODS}{_NOTES}{_MODS}class\s+(?P<n>\w+)"), ("interface!", rf"{_NOTES}{_MODS}(?:@\s*)?interface\s+(?P<n>\w+)"), ("enum!", rf"{_NOTES}{_MODS}enum\s+(?P<n>\w+)"), ("method", rf"{_NOTES}{_MODS}{_NOTES}{_MODS}(?:<[^{{}};()]{{0,300}}>\s*)?(?!(?:return|new|else|throw|case|assert|package|import)\b)[\w.$]+(?:\s*<[^{{}};()=]{{0,300}}>)?(?:\s*\[\s*\])*\s+(?P<n>\w+)\s*(?=\()")], [r"^[ \t]*import\s+(?:static\s+)?(\w+(?:\.\w+)*(?:\.\*)?)"], lambda n, kind, line: "public" not in line.split(n)[0] if kind == "class" else kind == "method" and "private" in re.sub(r"@\w+(?:\([^)]*\))?", "", line.split(n + "(")[0].split(n + " (")[0]).split(), members=r"\s*(?:throws[\w\s.,]+)?(?:default\b[^;]*)?[{;]"),
    "csharp": Language([("class!", rf"{_MODS}(?:class|struct|record)\s+(?P<n>\w+)"), ("interface", rf"{_MODS}interface\s+(?P<n>I\w+)"), ("enum", rf"{_MODS}enum\s+(?P<n>\w+)"), ("method", r"(?:(?:public|private|protected|internal|static|async|override|virtual|abstract|sealed|partial)\s+)+[\w<>\[\], ?.]+\s+(?P<n>\w+)\s*(?:<[^>()]*>)?\s*(?=\()")], [r"^[ \t]*using\s+(?:static\s+)?([\w.]+)\s*;"], lambda n, kind, line: "public" not in line if kind == "class" else kind == "method" and not line.startswith("public"), scope="file"),
    "php": Language([("class!", rf"{_MODS}(?:class|trait)\s+(?P<n>\w+)"), ("interface", r"interface\s+(?P<n>\w+)"), ("function", rf"{_MODS}function\s+&?(?P<n>\w+)")], [r"^[ \t]*use\s+([\w\\]+)\s*(?:;|as\b)", r"""\b(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"\n]+)['"]"""], lambda n, kind, line: kind not in ("class", "interface") and (line.startswith("private") or " private " in line.split("function")[0]), lambda x: x.replace("\\", "/"), scope="file"),
    "kotlin": Language([("class!", rf"{_MODS}class\s+(?P<n>\w+)"), ("class", rf"{_MODS}object\s+(?P<n>\w+)"), ("interface", rf"{_MODS}interface\s+(?P<n>\w+)"), ("function", rf"{_MODS}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<n>\w+)")], [r"^[ \t]*import\s+([\w.]+)"], lambda n, kind, line: kind not in ("class", "interface") and line.startswith(("private", "internal")), scope="file"),
    "swift": Language([("class!", rf"{_MODS}(?:class|actor)\s+(?P<n>[A-Z]\w*)"), ("struct!", rf"{_MODS}struct\s+(?P<n>\w+)"), ("enum!", rf"{_MODS}enum\s+(?P<n>\w+)"), ("interface", rf"{_MODS}protocol\s+(?P<n>\w+)"), ("function", rf"{_MODS}func\s+(?P<n>\w+)")], [r"^[ \t]*import\s+(\w+)"], lambda n, kind, line: not line.startswith(("public", "open")) if kind in ("class", "struct") else kind not in ("enum", "interface") and line.startswith(("private", "fileprivate")), scope="file"),
    "elixir": Language([("class!", r"defmodule\s+(?P<n>[\w.]+)"), ("function", r"def(?:p|macrop?)?\s+(?P<n>\w+[?!]?)")], [r"^[ \t]*(?:alias|import|use|require)\s+([\w.]+)"], lambda n, kind, line: bool(re.match(r"def(macro)?p\b", line)), scope="file", methods=False, exported=lambda n, kind, line: not line.startswith("defmacro")),
}


@dataclass
class _Found:
    kind: str
    at: int  # the declaration's first place
    name_at: int
    name: str
    parent: str | None  # as the declaration itself says
    end: int  # the end of what its pattern took
    hidden: bool = False  # whether a mark before it made it private


def _declarations(lexed: Lexed, rules: Language) -> list[_Found]:
    """Every place that looks like a declaration, in order; of two patterns that fit one name the first counts."""
    found: dict[int, _Found] = {}
    for kind, pattern in rules.compiled:
        for m in pattern.finditer(lexed.code):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            found.setdefault(m.start("n"), _Found(kind, at, m.start("n"), m["n"], m.groupdict().get("p"), m.end()))
    return [found[k] for k in sorted(found)]


def _arrow(code: str, tree: Tree, at: int) -> bool:
    """Whether the value after the first = from ``at`` on is an arrow function."""
    m = re.compile(r"[^=;\n]*?(?::(?:[^=;]|=>){0,400}?)?=(?![=>])\s*(?:async\b\s*)?(?:<[^>()]*>\s*)?").match(code, at)
    if not m:
        return False
    at = m.end()
    if code[at : at + 1] == "(" and (block := tree.block_at(at)) >= 0:
        return bool(re.compile(r"\s*(?::[^;{}()]*(?:\([^()]*\)[^;{}()]*)*)?=>").match(code, tree.closes[block] + 1)) or bool(re.compile(r"\s*:\s*[^;=]*=>").match(code, tree.closes[block] + 1))
    return bool(re.compile(r"[\w$]+\s*=>").match(code, at))


def _after_angles(code: str, at: int) -> int:
    """The place behind the type parameters that follow a name, if any do."""
    m = re.compile(r"\s*<").match(code, at)
    depth = 0
    for k in range(m.end() - 1, len(code)) if m else ():
        depth += (code[k] == "<") - (code[k] == ">" and code[k - 1] not in "=-")
        if depth == 0:
            return k + 1
    return at


_GOES_ON = re.compile(r"[=>.,&|?:+\-*/%(<\[]\s*\Z")
_STARTS_ON = re.compile(r"\s*(?:[=.,&|?:+\-*/%(\[]|=>)")


def _value_blocks(code: str, tree: Tree, at: int, limit: int) -> list[int]:
    """Brackets of a value that starts at ``at``: to the semicolon, or the line's end where nothing goes on."""
    out = []
    while (m := Tree._STEP.search(code, at)) and m.start() < limit and m[0] not in ";)]}":
        gap = code[at : m.start()]
        line, broken, rest = gap.partition("\n")
        if broken and out and not (_GOES_ON.search(line) or _STARTS_ON.match(rest) or not line.strip() and _STARTS_ON.match(rest + m[0])):
            break
        if broken and not out and not _GOES_ON.search(line):
            break
        if (block := tree.block_at(m.start())) < 0:
            break
        out.append(block)
        at = tree.closes[block] + 1
    return out


def _braced(lexed: Lexed, rules: Language, language: str) -> Iterator[tuple[_Found, str, str | None]]:
    """(declaration, kind, parent) of a language with braces."""
    code, tree = lexed.code, Tree(lexed.code, LEXICONS[language].brackets)
    role: dict[int, str | None] = {}  # of a bracket: the name of the container whose body it is, None for an opaque one
    known: dict[int, tuple[bool, str | None]] = {-1: (False, None)}
    last: str | None = None  # the container that lasts until the next one
    found = _declarations(lexed, rules)
    for k, d in enumerate(found):
        around = tree.inner(d.name_at)
        direct = role.get(around, "") or ""
        opaque, parent = _surroundings(tree, role, known, around)
        kind = d.kind.rstrip("!~")
        if opaque:
            continue
        if language == "go" and kind in ("type", "const", "struct", "interface"):
            kind = _go_kind(code, tree, d, around, kind)
            if kind is None:
                continue
        elif around >= 0 and code[tree.opens[around]] != "{":
            continue  # inside parentheses
        limit = found[k + 1].at if k + 1 < len(found) and tree.inner(found[k + 1].name_at) == around and found[k + 1].kind != "const~" else tree.size
        if kind == "const" and language in ("javascript", "typescript"):
            arrow = d.name[0] not in "{[" and _arrow(code, tree, d.end)
            for block in _value_blocks(code, tree, d.end - (d.name[0] in "{["), tree.size):
                role[block] = None
            if d.name[0] in "{[" or not (arrow or lexed.code.startswith("export", d.at)):
                continue
            yield d, "function" if arrow else "const", None
            continue
        if kind == "method" and language != "go":
            if rules.scope == "brace":
                if not direct or d.name in _NOT_NAMES or (block := tree.block_at(code.find("(", d.end))) < 0 or not re.compile(rules.members).match(code, tree.closes[block] + 1):
                    continue
                parent = direct
                if d.name == direct:
                    continue  # a constructor
            elif d.name in _NOT_NAMES or d.name == last:
                continue
        if rules.scope == "file":
            parent = last if kind in ("function", "method") else None
            if kind == "method" and parent is None:
                continue
            if d.kind.endswith("!"):
                last = d.name
        body = tree.body(_after_angles(code, d.end), limit)
        if kind == "function" and rules.methods and parent and language != "bash":
            kind = "method"
        if body >= 0:
            if d.kind.endswith("!"):
                role[body] = d.name.split("<")[0]
            elif d.kind.endswith("~") or kind in ("function", "method"):
                role[body] = None
        if kind in ("impl", "macro"):
            continue
        yield d, kind, d.parent or (parent if kind in ("function", "method") else None)


def _surroundings(tree: Tree, role: dict[int, str | None], known: dict[int, tuple[bool, str | None]], block: int) -> tuple[bool, str | None]:
    """(whether something opaque is around, name of the nearest container) of what stands in a bracket; ``known`` keeps answers, as a bracket's role is settled before what it holds."""
    path = []
    while block not in known:
        path.append(block)
        block = tree.parents[block]
    for inner in reversed(path):
        opaque, parent = known[block]
        known[inner] = (opaque or inner in role and role[inner] is None, role.get(inner) or parent)
        block = inner
    return known[block]


def _go_kind(code: str, tree: Tree, d: _Found, around: int, kind: str) -> str | None:
    """The kind of a Go declaration: by its own word, or inside a group by the word before the group's parenthesis."""
    word = re.match(r"type|const|var|func|import|package", code[d.at : d.at + 8])
    if around < 0:
        return (kind if kind != "const" else None if word and word[0] == "type" else kind) if word and word[0] in ("type", "const", "var") and d.name not in ("type", "const", "var") and (word[0] == "type") == (kind != "const") else ("const" if word and word[0] in ("const", "var") and d.name not in ("type", "const", "var") else None)
    before = re.search(r"\b(type|const|var)\s*\Z", code[max(0, tree.opens[around] - 40) : tree.opens[around]]) if code[tree.opens[around]] == "(" else None
    if not before or tree.parents[around] >= 0:
        return None
    return "const" if before[1] != "type" else kind if kind != "const" else "type"


def _indented(lexed: Lexed, rules: Language) -> Iterator[tuple[_Found, str, str | None]]:
    """(declaration, kind, parent) of Python: bodies by the indentation of logical lines."""
    code, tree = lexed.code, Tree(lexed.code)
    by_line = {lexed.line(d.at): d for d in _declarations(lexed, rules) if tree.inner(d.at) < 0}
    open_: list[tuple[int, str | None]] = []  # indentation, name of a class or None for a function
    for number, (start, line) in enumerate(zip(lexed.line_starts, code.split("\n")), 1):
        if not line.strip() or tree.inner(start) >= 0 or _within_string(lexed, start):
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and indent <= open_[-1][0]:
            open_.pop()
        d = by_line.get(number)
        if d is None or any(name is None for _, name in open_):
            continue
        parent = open_[-1][1] if open_ else None
        kind = d.kind.rstrip("!")
        if kind == "const":
            if parent is None and len(d.name) > 1:
                yield d, kind, None
            continue
        open_.append((indent, d.name if kind == "class" else None))
        yield d, "method" if kind == "function" and parent else kind, parent if kind != "class" else None


def _within_string(lexed: Lexed, at: int) -> bool:
    """Whether a line begins inside a string."""
    k = bisect.bisect_left(lexed.strings, (at, -1)) - 1
    return k >= 0 and at < lexed.strings[k][1]


_WORDS = re.compile(r"(?P<mark>^[ \t]*private[ \t]*$)|(?<![\w.:@$])(?P<open>class|module|def|begin|case|if|unless|while|until|for|do)\b(?![?!:])|(?<![\w.:@$])(?P<close>end)\b(?![?!:=])", re.M)


def _ended(lexed: Lexed, rules: Language) -> Iterator[tuple[_Found, str, str | None]]:
    """(declaration, kind, parent) of Ruby: bodies end with their ``end``; a modifier or the ``do`` of a loop opens none."""
    code = lexed.code
    by_place: dict[int, _Found] = {}
    for d in _declarations(lexed, rules):
        word = re.compile(r"(?:private|public|protected|private_class_method)\s+(?=def)").match(code, d.at)
        by_place[word.end() if word else d.at] = d
    open_: list[list] = []  # [container, def or block; name; whether its methods are private from here on]
    for m in _WORDS.finditer(code):
        line_start = code.rfind("\n", 0, m.start()) + 1
        before = code[line_start : m.start()]
        if m["close"]:
            if open_:
                open_.pop()
            continue
        holders = [x for x in open_ if x[0] == "container"]
        if m["mark"]:
            if holders:
                holders[-1][2] = True
            continue
        word = m["open"]
        if word in ("if", "unless", "while", "until", "for") and before.strip() and not re.search(r"(?:[=(,;\[|&]|\bthen|\belse|\bdo|\breturn)[ \t]*\Z", before):
            continue
        if word == "do" and re.match(r"[ \t]*(?:while|until|for)\b", before):
            continue
        d = by_place.get(m.start())
        listed = d is not None and not any(x[0] == "def" for x in open_)
        if word in ("class", "module") and d:
            open_.append(["container", d.name, False])
            if listed:
                yield d, "class", None
            continue
        if not (word == "def" and re.compile(r"def\s+(?:self\.)?\w+[?!]?\s*(?:\([^()\n]*\))?\s*=(?![=~])").match(code, m.start())):  # else an endless method
            open_.append(["def" if word == "def" else "block", None, False])
        if listed:
            d.hidden = bool(holders) and holders[-1][2]
            yield d, "method" if holders else "function", holders[-1][1] if holders else None


def _docs(lexed: Lexed, rules: Language, language: str, d: _Found) -> str | None:
    """The first line of the doc comment right before a declaration, or of the string that begins a Python body."""
    text, code = lexed.text, lexed.code
    if language == "python":
        return _docstring(lexed, d)
    if not rules.doc:
        return None
    first = bisect.bisect_left(lexed.comments, (d.at, -1))
    at, doc = d.at, None
    while first:
        begin, end = lexed.comments[first - 1]
        between = text[end:at]
        if language == "rust":
            between = re.sub(r"#!?\[[^\]]*\]", "", between)  # attributes stand between a comment and what it is about
        if between.strip(" \t\r\n@") and not re.fullmatch(r"\s*(?:@\w+(?:\([^()]*\))?\s*)*(?:export\s+)?(?:default\s+)?", between) or between.count("\n") > 1 + (language == "rust" and between.count("\n")):
            break
        if code[code.rfind("\n", 0, begin) + 1 : begin].strip() or not re.match(rules.doc, text[begin:end]):
            break
        if rules.doc.startswith("/\\*"):
            lines = (x.strip().lstrip("*").strip() for x in text[begin + 3 : end - 2].split("\n"))
            return next((x for x in lines if x and not x.startswith("@")), None)
        doc = text[begin:end].lstrip("/").strip() or doc
        at, first = begin, first - 1
    return doc


def _docstring(lexed: Lexed, d: _Found) -> str | None:
    code, at, depth = lexed.code, d.end, 0
    while at < len(code) and (depth or code[at] != ":"):  # the colon that ends the header
        depth += (code[at] in "([{") - (code[at] in ")]}")
        if code[at] == "\n" and not depth:
            return None
        at += 1
    m = re.compile(r"\s*").match(code, at + 1)
    end = lexed.string_at.get(m.end()) if at < len(code) else None
    if end is None or d.kind == "const":
        return None
    body = re.sub(r"""^[a-zA-Z]*(\"{3}|'{3}|\"|')""", "", lexed.text[m.end() : end])
    return re.sub(r"""(\"{3}|'{3}|\"|')$""", "", body).strip().split("\n")[0].strip() or None


def _imports(lexed: Lexed, rules: Language, language: str) -> set[str]:
    """Cleaned imports that begin in code; what they name may be a string."""
    out: set[str] = set()
    text, code = lexed.text, lexed.code
    for source in rules.sources:
        for m in source.finditer(text):
            word = re.search(r"[\w.]", m[0])
            at = m.start() + (word.start() if word else 0)
            if code[at] != text[at] and not (text[at - 1] in "\"'`" and code[at - 1] == '"' and m[0].strip()[0] in "\"'`" or re.match(r"\s*(?:[\w.]+\s+)?[\"]", m[0]) and _opens_string(lexed, m)):
                continue
            if language == "go" and not m[0].lstrip().startswith("import") and not _in_import_group(code, m.start(1) - 1):
                continue
            named = text[m.start(1) : lexed.string_at[m.start(1)]] if language == "bash" and m.start(1) in lexed.string_at else m[1]
            for part in named.split(",") if language == "python" else [named]:
                cleaned = rules.clean(part.strip())
                out.update([cleaned] if isinstance(cleaned, str) else cleaned or [])
    return out


def _opens_string(lexed: Lexed, m: re.Match) -> bool:
    """Whether the quotation mark before the match's group opens a string of its own."""
    return m.start(1) - 1 in lexed.string_at


def _in_import_group(code: str, at: int) -> bool:
    opens = code.rfind("(", 0, at)
    return opens >= 0 and code.find(")", opens, at) < 0 and bool(re.search(r"\bimport\s*\Z", code[max(0, opens - 20) : opens]))


def parse(content: str, path: str, language: str) -> tuple[list[dict], list[str], list[str]]:
    """(symbols, sorted distinct imports, exports in order) of one file."""
    rules = LANGUAGES[language]
    lexed = lex(content, LEXICONS[language])
    walk = _indented(lexed, rules) if rules.scope == "indent" else _ended(lexed, rules) if rules.scope == "end" else _braced(lexed, rules, language)
    symbols, exports = [], []
    for d, kind, parent in walk:
        end = content.find("\n", d.name_at)
        line = " ".join(content[d.at : d.name_at].split("\n")) + content[d.name_at : end if end >= 0 else len(content)].strip()
        private = d.hidden and kind in ("function", "method") or rules.private(d.name, kind, line)
        symbols.append({"name": d.name, "kind": kind, "file": path, "line": lexed.line(d.name_at), "signature": line[:80] if kind == "const" and language != "python" else line, "visibility": "private" if private else "public", "docstring": _docs(lexed, rules, language, d), "parent": parent})
        if not private and rules.exported(d.name, kind, line):
            exports.append(d.name)
    return symbols, sorted(_imports(lexed, rules, language)), exports


_FIELDS = ("name", "kind", "file", "line", "signature", "visibility", "docstring", "parent")
_SYMBOLS = pa.struct([(f, pa.int64() if f == "line" else pa.string()) for f in _FIELDS])


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    """A list column, its entries as one flat array."""
    flat = [x for r in rows for x in r]
    values = pa.StructArray.from_arrays([pa.array([x[f.name] for x in flat], f.type) for f in kind], [f.name for f in kind]) if pa.types.is_struct(kind) else pa.array(flat, kind)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)


def parse_files(files: DataFrame) -> DataFrame:
    """(path, language, symbols, imports, exports) of ``files`` (path, content, language), and their ``hash`` if they have one."""
    keep = ["hash"] if "hash" in files.columns else []
    schema = ", ".join([f"path string, language string, symbols array<{SYMBOL}>, imports array<string>, exports array<string>", *(f"{c} {files.schema[c].dataType.simpleString()}" for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(c or "", p, x) for c, p, x in zip(*(batch.column(n).to_pylist() for n in ("content", "path", "language")))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("language"), _lists([x[0] for x in parsed], _SYMBOLS), _lists([x[1] for x in parsed], pa.string()), _lists([x[2] for x in parsed], pa.string()), *map(batch.column, keep)], ["path", "language", "symbols", "imports", "exports", *keep])

    known = files.where(F.col("language").isin(*LANGUAGES)).select("path", "content", "language", *keep)
    return known.mapInArrow(run, schema)


class SymbolParser:
    """A table function: a row for each symbol of a file, by (path, content, language)."""

    def eval(self, path: str, content: str, language: str):
        if language in LANGUAGES and content is not None:
            for s in parse(content, path, language)[0]:
                yield tuple(s[f] for f in _FIELDS)


def register(spark: SparkSession, name: str = "parse_symbols") -> str:
    """Make the parsers a table function of the session's SQL: ``FROM files, LATERAL parse_symbols(path, content, language)``."""
    spark.udtf.register(name, F.udtf(SymbolParser, returnType=", ".join(f"{f} {'long' if f == 'line' else 'string'}" for f in _FIELDS)))
    return name
