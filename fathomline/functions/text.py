"""Text measures as column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that count as decisions.
DECISIONS = ("if", "elif", "elsif", "else", "for", "while", "case", "when", "catch", "except", "rescue")
SECRET = r"(?i)(API_KEY|SECRET|PASSWORD|TOKEN)\s*=\s*['\"]?[A-Za-z0-9/+=]{8,}"


def trim(x: Column) -> Column:
    """Without white space of any kind at the ends (``F.trim`` takes blanks only)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def lines(content: Column) -> Column:
    """Lines without their ends; no empty line after a final line end, none at all for the empty text."""
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(content, r"\r?\n\z", ""), r"\r?\n"))


def count_lines(content: Column) -> Column:
    return (F.regexp_count(content, F.lit("\n")) + F.when((content != "") & ~content.endswith("\n"), 1).otherwise(0)).cast("long")


#: White space inside a line, and the flags under which only a line feed ends lines.
_GAP, _LINES = r"[ \t\r\f\x0B]*", "(?dm)"
_WORD = r"[\p{IsAlphabetic}\p{N}_]"


def _count(content: Column, pattern: str) -> Column:
    return F.regexp_count(content, F.lit(pattern))


def cyclomatic(content: Column) -> Column:
    """1, and for every line that is no comment its decision words, && and ||, and one for ? with :."""
    code = F.regexp_replace(content, rf"{_LINES}^{_GAP}(?://|#|\*|/\*).*$", "")
    words = _count(code, rf"(?<!{_WORD})(?:{'|'.join(DECISIONS)})(?!{_WORD})")
    return (1 + words + _count(code, "&&") + _count(code, r"\|\|") + _count(code, rf"{_LINES}^(?=.*\?)(?=.*:).*$")).cast("long")


def logical_loc(content: Column) -> Column:
    """Lines that are neither blank nor comments; a block comment's lines, from opening to closing, don't count."""
    def step(state: Column, line: Column) -> Column:
        t = trim(line)
        opens, closes = t.startswith("/*"), t.contains("*/")
        inside = state["inside"]
        counts = ~inside & ~opens & (t != "") & ~t.startswith("//") & ~t.startswith("#")
        return F.struct((state["n"] + F.when(counts, 1).otherwise(0)).alias("n"), F.when(inside, ~closes).otherwise(opens & ~closes).alias("inside"))

    return F.aggregate(lines(content), F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside")), step)["n"].cast("long")


def func_line(line: Column) -> Column:
    t = trim(line)
    starts = F.lit(False)
    for word in ("def ", "fn ", "func ", "function "):
        starts = starts | t.startswith(word)
    return starts | t.contains("function ") | (t.contains("=>") & t.contains("const "))


def code_patterns(content: Column) -> Column:
    """Names of the size and style limits that a file passes, in fixed order; each pattern consumes whole lines."""
    functions = rf"{_LINES}^(?:{_GAP}(?:def |fn |func )|.*function |(?=.*=>).*const ).*$"
    return F.array_compact(F.array(
        F.when(count_lines(content) > 500, "large_file"),
        F.when(_count(content, functions) > 20, "many_functions"),
        F.when(_count(F.upper(content), rf"{_LINES}^.*(?:TODO|FIXME|HACK).*$") > 5, "many_todos"),
        F.when(_count(content, rf"{_LINES}^(?:[ \t\r\f\x0B]{{20}}|\t{{5}}).*$") > 10, "deep_nesting"),
    ))


def secrets(content: Column) -> Column:
    return content.rlike(SECRET)


def fenced_command(content: Column, label: str) -> Column:
    """First line inside ``` fences that names the label in any case, trimmed; null if none does."""
    def step(state: Column, line: Column) -> Column:
        t = trim(line)
        fence = t.startswith("```")
        hit = state["inside"] & ~fence & (t != "") & F.lower(t).contains(label.lower())
        return F.struct(F.when(fence, ~state["inside"]).otherwise(state["inside"]).alias("inside"), F.coalesce(state["found"], F.when(hit, t)).alias("found"))

    return F.aggregate(lines(content), F.struct(F.lit(False).alias("inside"), F.lit(None).cast("string").alias("found")), step)["found"]


def djb2(content: Column) -> Column:
    """16 hex digits of the 64-bit hash that multiplies by 33 and adds each byte, starting from 5381."""
    digits = F.regexp_extract_all(F.hex(F.encode(content, "UTF-8")), F.lit("(..)"), F.lit(1))
    whole = "decimal(20,0)"
    step = lambda h, b: F.pmod(h * F.lit(33).cast("decimal(2,0)") + F.conv(b, 16, 10).cast("decimal(3,0)"), F.lit(str(1 << 64)).cast(whole)).cast(whole)
    return F.lpad(F.lower(F.conv(F.aggregate(digits, F.lit(5381).cast(whole), step).cast("string"), 10, 16)), 16, "0")
