"""Ignore files of a source tree: which names a walk leaves out."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file: ``keeps`` for a leading !, ``folder`` for a final slash."""

    pattern: re.Pattern
    keeps: bool
    folder: bool


def _regex(glob: str) -> str:
    """The glob as a regular expression over a path below the ignore file's directory."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def parse(text: str) -> list[Rule]:
    """Rules of an ignore file in order; comments and blank lines go, lines that are no valid glob too."""
    rules = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if not line.endswith("\\ "):
            line = line.rstrip(" ")
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        line = line[keeps:]
        folder = line.endswith("/")
        line = line.rstrip("/") if folder else line
        anchored = "/" in line
        body = _regex(line.lstrip("/"))
        try:
            rules.append(Rule(re.compile(body if anchored else f"(?:.*/)?{body}"), keeps, folder))
        except re.error:
            continue
    return rules


def ignored(path: str, is_folder: bool, levels: list[tuple[str, list[Rule]]]) -> bool:
    """Whether the last rule that fits ``path`` leaves it out.

    ``levels`` are (directory with a final slash or empty, rules) from the root down; a deeper file
    overrules the ones above it. Folders that are left out are not entered, so nothing below them
    can come back.
    """
    for folder, rules in reversed(levels):
        below = path[len(folder) :]
        for rule in reversed(rules):
            if (is_folder or not rule.folder) and rule.pattern.fullmatch(below):
                return not rule.keeps
    return False
