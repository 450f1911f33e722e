"""Line-delimited JSON requests over an index and a manifest: query tools and resources as dispatch tables.

Every answer is bounded: tools return top lists, one file's facts or a page of rows, resources one
row's text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import domains
from ..operators.profile import COMMANDS, UNSET
from .index import Index

#: Rows of a page where an answer could be as long as the collection.
PAGE = 100
SCHEME = "repo://"


@dataclass
class Served:
    """What requests are answered from; ``refresh`` builds both anew."""

    index: Index | None = None
    manifest: DataFrame | None = None
    refresh: Callable[[], Served] | None = None


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def _page(df: DataFrame, order: list[str], args: dict) -> dict:
    """One page of rows in order, and whether more follow."""
    at = max(0, int(args.get("offset", 0)))
    rows = _rows(df.orderBy(*order).offset(at).limit(PAGE + 1))
    return {"rows": rows[:PAGE], "more": len(rows) > PAGE, "offset": at}


def _index(s: Served) -> Index:
    if s.index is None:
        raise ValueError("no index loaded")
    return s.index


def _manifest(s: Served) -> DataFrame:
    if s.manifest is None:
        raise ValueError("no manifest loaded")
    return s.manifest.limit(1)


def file_symbols(s: Served, args: dict) -> object:
    found = _page(_index(s).file_symbols(args["path"]), ["line", "name"], args)
    return found if found["rows"] or found["offset"] else f"no symbols found for {args['path']}"


def find_tests(s: Served, args: dict) -> dict:
    return {"source": args.get("path") or "*", **_page(_index(s).find_tests(args.get("path", "")), ["path"], args)}


def check_invariants(s: Served, args: dict) -> list[dict]:
    rows = _manifest(s)
    found = rows.select("repo", F.explode("domain.detected_domains").alias("d")).select("repo", "d.domain")
    return _rows(domains.invariant_rules(rows, found).drop("repo").orderBy("id"))


def refresh(s: Served, args: dict) -> dict:
    if s.refresh is None:
        return {"success": False, "error": "nothing to refresh from"}
    new = s.refresh()
    s.index, s.manifest = new.index, new.manifest
    return {"success": True, "output": str(_rows(_index(s).meta().select("total_files", "total_symbols", "total_edges"))[0])}


def _schema(required: tuple[str, ...] = (), **kinds: str) -> dict:
    return {"type": "object", "properties": {k: {"type": v} for k, v in kinds.items()}, **({"required": list(required)} if required else {})}


#: Tool -> (what it does, its arguments, the function).
TOOLS: dict[str, tuple[str, dict, Callable[[Served, dict], object]]] = {
    "get_top_files": ("Most important files", _schema(limit="number"), lambda s, a: _rows(_index(s).top_files(int(a.get("limit", 10))))),
    "get_file_symbols": ("Symbols of a file", _schema(("path",), path="string", offset="number"), file_symbols),
    "search_symbols": ("Symbols by a part of their name", _schema(("query",), query="string"), lambda s, a: _rows(_index(s).search_symbols(a["query"]))),
    "analyze_file": ("Symbols, imports and importers of a file", _schema(("path",), path="string", offset="number"), lambda s, a: _page(_index(s).analyze_file(a["path"]), ["fact", "name"], a)),
    "find_tests": ("Test files and test functions, of one source or of all", _schema(path="string", offset="number"), find_tests),
    "check_invariants": ("Invariants of the collection", _schema(), check_invariants),
    "refresh": ("Build index and manifest anew", _schema(), refresh),
}


def commands_text(manifest: DataFrame) -> DataFrame:
    """(repo, text): a line for every command that is set."""
    rows = [F.when(F.col(f"commands.{c}") != UNSET, F.concat(F.lit(f"{c}: "), F.col(f"commands.{c}"))) for c in sorted(COMMANDS)]
    return manifest.select("repo", F.concat_ws("\n", *rows).alias("text"))


def invariants_text(manifest: DataFrame) -> DataFrame:
    """(repo, text): the general invariant, and the labelled ones of the domains that were found."""
    found = F.coalesce(F.transform("domain.detected_domains", lambda d: d["domain"]), F.array().cast("array<string>"))
    rows = [F.when(F.array_contains(found, d), f"{label}: {rule}") for d, label, rule in domains.DOMAIN_RULES]
    return manifest.select("repo", F.concat_ws("\n", F.lit(f"{domains.RULES[0][1]}: {domains.RULES[0][2]}"), *rows).alias("text"))


def architecture_text(manifest: DataFrame) -> DataFrame:
    """(repo, text): stack and archetype."""
    return manifest.select("repo", F.format_string("Stack: %s/%s\nArchetype: %s", "stack.language", "stack.framework", "archetype.archetype").alias("text"))


def _text(rows: Callable[[DataFrame], DataFrame]) -> Callable[[Served], str]:
    return lambda s: rows(_manifest(s)).first()["text"]


#: Resource -> (name, media type, whether it needs the index, its text).
RESOURCES: dict[str, tuple[str, str, bool, Callable[[Served], str]]] = {
    "manifest": ("Manifest", "application/json", False, lambda s: _manifest(s).select(F.to_json(F.struct("*")).alias("text")).first()["text"]),
    "code-index": ("Code index", "application/json", True, lambda s: _index(s).meta().select(F.to_json(F.struct("*")).alias("text")).first()["text"]),
    "commands": ("Commands", "text/plain", False, _text(commands_text)),
    "invariants": ("Invariants", "text/plain", False, _text(invariants_text)),
    "architecture": ("Architecture", "text/plain", False, _text(architecture_text)),
}


def _result(served: Served, method: str, params: dict) -> object:
    if method == "initialize":
        return {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "fathomline", "version": "1"}}
    if method in ("initialized", "notifications/initialized"):
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "description": d, "inputSchema": schema} for n, (d, schema, _) in TOOLS.items()]}
    if method == "resources/list":
        there = lambda needs_index: served.index is not None if needs_index else served.manifest is not None
        return {"resources": [{"uri": SCHEME + u, "name": n, "mimeType": m} for u, (n, m, needs, _) in RESOURCES.items() if there(needs)]}
    if method == "resources/read":
        uri = params["uri"]
        if uri.removeprefix(SCHEME) not in RESOURCES:
            raise KeyError(f"unknown resource {uri}")
        _, kind, _, content = RESOURCES[uri.removeprefix(SCHEME)]
        return {"contents": [{"uri": uri, "mimeType": kind, "text": content(served)}]}
    if method == "tools/call":
        if params["name"] not in TOOLS:
            raise KeyError(f"unknown tool {params['name']}")
        return {"content": [{"type": "text", "text": json.dumps(TOOLS[params["name"]][2](served, params.get("arguments") or {}), default=str)}]}
    raise KeyError(f"unknown method {method}")


def serve(served: Index | Served, requests: Iterable[str]) -> Iterator[str]:
    """One response line a request line; blank lines are skipped."""
    served = Served(index=served) if isinstance(served, Index) else replace(served)
    for line in requests:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError:
            yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
            continue
        answer: dict = {"jsonrpc": "2.0", "id": request.get("id")}
        try:
            answer["result"] = _result(served, request.get("method", ""), request.get("params") or {})
        except Exception as error:  # noqa: BLE001
            answer["error"] = {"code": -32603, "message": f"{type(error).__name__}: {error}"[:500]}
        yield json.dumps(answer, default=str)
