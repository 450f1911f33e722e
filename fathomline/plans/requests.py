"""Requests as a table or a stream: lines of JSON joined with the index's tables.

Each request is parsed by Spark, asks with a tool and an argument, and takes its page of that tool's facts. What
is asked again and again is answered once: facts are found for distinct arguments, then joined back.
The answers are those of ``server``, one request at a time, as rows (request, code, pos, fact);
``respond`` makes a line of JSON of each request's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import search
from ..sources.shared import written
from ..streaming.incremental import run_available
from .index import Index
from .server import PAGE, TOOLS

_LINE = "id string, method string, params struct<name:string,uri:string,arguments:struct<path:string,query:string,limit:double,offset:double>>, _broken string"
#: Fixed values of the protocol: what can't be parsed, and what fails.
PARSE, FAILED = -32700, -32603
#: Most rows that top lists and searches give.
MOST = 20


def parsed(requests: DataFrame) -> DataFrame:
    """(request, line) with id, code, error, tool, argument, skip and most; blank lines go."""
    line = F.from_json("line", _LINE, {"columnNameOfCorruptRecord": "_broken"})
    rows = requests.where(F.trim("line") != "").select("request", line.alias("r")).select("request", "r.*")
    method, name, arguments = F.col("method"), F.col("params.name"), F.col("params.arguments")
    tool = F.when(method == "tools/call", name).when(method == "tools/list", method)
    broken = F.col("_broken").isNotNull() | (method.isNull() & F.col("id").isNull() & F.col("params").isNull())
    lacks = lambda *tools: tool.isin(*tools)
    argument = F.when(lacks("get_file_symbols", "analyze_file", "find_tests"), arguments["path"]).when(lacks("search_symbols"), arguments["query"]).otherwise("")
    error = (
        F.when(broken, "parse error")
        .when(method.isNull() | ~method.isin("tools/call", "tools/list"), F.concat(F.lit("unknown method "), F.coalesce(method, F.lit(""))))
        .when((method == "tools/call") & (name.isNull() | ~name.isin("get_top_files", "get_file_symbols", "search_symbols", "analyze_file", "find_tests")), F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit(""))))
        .when(argument.isNull() & ~lacks("find_tests"), F.concat(name, F.lit(" lacks an argument")))
    )
    offset = F.greatest(F.coalesce(arguments["offset"], F.lit(0.0)), F.lit(0.0)).cast("long")
    limit = F.least(F.coalesce(arguments["limit"], F.lit(10.0)), F.lit(float(MOST))).cast("long")
    paged = lacks("get_file_symbols", "analyze_file", "find_tests")
    return rows.select(
        "request", "id", F.when(broken, PARSE).when(error.isNotNull(), FAILED).otherwise(0).alias("code"), error.alias("error"), F.when(error.isNull(), tool).alias("tool"),
        F.coalesce(argument, F.lit("")).alias("argument"), F.when(paged, offset).otherwise(0).alias("skip"), F.when(tool == "get_top_files", limit).when(paged, PAGE).otherwise(MOST).alias("most"),
    )


def _facts(asks: DataFrame, index: Index, last: int) -> DataFrame:
    """(tool, argument, pos, fact) of the distinct asks (tool, argument), up to ``last`` of each."""
    of = lambda tool: asks.where(F.col("tool") == tool).select("argument")
    told = lambda tool, rows, fact, n=last: search.first_of_each(rows, "argument", ["o1", "o2"], n).select(F.lit(tool).alias("tool"), "argument", "pos", fact.alias("fact"))
    words = lambda *columns: F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))
    in_file = index.symbols.select(F.col("file").alias("argument"), F.col("line").alias("o1"), F.col("name").alias("o2"), "kind")
    symbols = told("get_file_symbols", in_file.join(of("get_file_symbols"), "argument"), words("o2", "kind", "o1"))

    row = lambda table, own, kind, name: table.select(F.col(own).alias("argument"), F.lit(kind).alias("o1"), F.col(name).alias("o2"))
    known = row(index.symbols, "file", "symbol", "name").unionByName(row(index.edges, "source", "imports_from", "target")).unionByName(row(index.edges, "target", "imported_by", "source"))
    analyses = told("analyze_file", known.join(of("analyze_file"), "argument"), words("o1", "o2"))

    queries = of("search_symbols").withColumnRenamed("argument", "query")
    hits = search.find_many(index.postings, "name", queries) if index.postings is not None else search.find_among(index.symbols.select("file", "line", "name"), "name", queries)
    hits = hits.select(F.col("query").alias("argument"), F.col("file").alias("o1"), F.col("line").alias("o2"), "name")
    found = told("search_symbols", hits, words("o1", "name", "o2"), MOST)

    tests = index.files.where(F.col("path").contains("test") | F.col("path").contains("spec")).select("path")
    stems = of("find_tests").withColumn("query", paths.stem(F.col("argument")))
    near = search.find_among(tests, "path", stems.select("query"), exact=True).join(stems, "query").select("argument", F.col("path").alias("o1"), F.lit("").alias("o2"))
    every = tests.join(F.broadcast(stems.where("argument = ''").select("argument").limit(1))).select("argument", F.col("path").alias("o1"), F.lit("").alias("o2"))  # one row: without a path all tests are asked for
    tested = told("find_tests", near.unionByName(every), F.col("o1"))

    top = told("get_top_files", index.top_files(MOST).select(F.lit("").alias("argument"), (-F.col("importance")).alias("o1"), F.col("path").alias("o2")), F.concat_ws(" ", "o2", (-F.col("o1")).cast("string")), MOST)
    spark = asks.sparkSession
    listed = spark.range(1).select(F.posexplode(F.array(*map(F.lit, TOOLS))).alias("pos", "fact")).select(F.lit("tools/list").alias("tool"), F.lit("").alias("argument"), (F.col("pos") + 1).alias("pos"), "fact")
    return symbols.unionByName(analyses).unionByName(found).unionByName(tested).unionByName(top).unionByName(listed)


def answers(requests: DataFrame, index: Index) -> DataFrame:
    """(request, id, code, pos, fact) of ``requests`` (request, line): a page of facts each, one row of position 0 where there is none or an error."""
    asked = written(parsed(requests))
    last = asked.agg(F.max(F.col("skip") + F.col("most"))).first()[0] or 0
    facts = _facts(written(asked.where("tool is not null").select("tool", "argument").distinct()), index, last)
    page = (facts["pos"] > F.col("skip")) & (facts["pos"] <= F.col("skip") + F.col("most"))
    joined = asked.join(facts, (asked["tool"] == facts["tool"]) & (asked["argument"] == facts["argument"]) & page, "left")
    return joined.select("request", "id", "code", F.coalesce(facts["pos"], F.lit(0)).alias("pos"), F.coalesce(F.col("error"), F.col("fact"), F.lit("")).alias("fact"))


def respond(requests: DataFrame, index: Index) -> DataFrame:
    """(request, response): a line of JSON each; a page bounds what is gathered for one."""
    rows = answers(requests, index)
    gathered = rows.groupBy("request").agg(F.first("id").alias("id"), F.first("code").alias("code"), F.sort_array(F.collect_list(F.struct("pos", "fact"))).alias("f"))
    facts: Column = F.filter(F.col("f"), lambda x: x["pos"] > 0)["fact"]
    result = F.when(F.col("code") == 0, F.struct(facts.alias("rows")))
    error = F.when(F.col("code") != 0, F.struct(F.col("code").alias("code"), F.col("f")[0]["fact"].alias("message")))
    return gathered.select("request", F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), "id", result.alias("result"), error.alias("error"))).alias("response"))


def serve_stream(stream: DataFrame, index: Index, path: str, checkpoint: str | None = None) -> DataFrame:
    """Answers all requests (request, line) of a stream that are there now, and returns the table of responses under ``path``; a batch that is run again replaces its own part."""

    def each(batch: DataFrame, number: int) -> None:
        rows = respond(batch, index).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(path)

    run_available(stream, each, checkpoint=checkpoint)
    kind = dict(stream.dtypes)["request"]
    return stream.sparkSession.read.schema(f"request {kind}, response string, batch long").parquet(path)
