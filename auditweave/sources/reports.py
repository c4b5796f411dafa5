"""Scanner reports as typed nested rows.

``reports(run_id, repo, tool, part, payload)`` holds one JSON document per row;
a large report may come in several parts, numbered from 0.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Numbers are read as text first: a number written as a string must not void its row.
SEMGREP_DDL = (
    "results ARRAY<STRUCT<path: STRING, check_id: STRING, start: STRUCT<line: STRING>, "
    "`end`: STRUCT<line: STRING>, extra: STRUCT<message: STRING>>>"
)
BANDIT_DDL = (
    "results ARRAY<STRUCT<filename: STRING, line_number: STRING, issue_text: STRING, test_name: STRING>>"
)
OSV_DDL = (
    "results ARRAY<STRUCT<source: STRUCT<path: STRING>, packages: ARRAY<STRUCT<"
    "package: STRUCT<name: STRING, ecosystem: STRING, version: STRING>, vulnerabilities: ARRAY<STRUCT<"
    "id: STRING, aliases: ARRAY<STRING>, database_specific: STRUCT<severity: STRING>, "
    "affected: ARRAY<STRUCT<ranges: ARRAY<STRUCT<events: ARRAY<STRUCT<fixed: STRING>>>>>>>>>>>>"
)
REPORT_DDL = {"semgrep": SEMGREP_DDL, "bandit": BANDIT_DDL, "osv-scanner": OSV_DDL}


def read_report_texts(spark: SparkSession, path: str) -> DataFrame:
    """Report files below ``path``, one per row, laid out as run_id=…/repo=…/tool=…/part=….json.

    Run, repository and tool are partition columns: a filter on them skips whole folders.
    """
    texts = spark.read.schema("value STRING, run_id STRING, repo STRING, tool STRING").option("wholetext", True).text(path)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part=(\d+)", 1).cast("bigint")
    return texts.select("run_id", "repo", "tool", part.alias("part"), F.col("value").alias("payload"))


#: A token of JSON behind white space: a string, a number or word, or a mark.
_TOKEN = re.compile(
    r'[ \t\n\r]*(?:("[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")'
    r"|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity)|([{}\[\]:,]))"
)
KEY, FIRST_KEY, COLON, VALUE, FIRST_VALUE, NEXT = range(6)


def _read_object(text: str, begin: int, seen: set[int], ends: dict[int, int]) -> None:
    """Read tokens from the brace at ``begin`` until its object ends or can't go on.

    Every object on the way is noted in ``seen`` and, once complete, in ``ends``: read from its own brace, it
    would be the same.
    """
    open_starts, place, expected = [], begin, VALUE
    while token := _TOKEN.match(text, place):
        start, place = token.start(token.lastindex), token.end()
        string, word, mark = token.groups()
        if mark in ("{", "[") and expected in (VALUE, FIRST_VALUE):
            open_starts.append(start if mark == "{" else ~start)
            expected = FIRST_KEY if mark == "{" else FIRST_VALUE
            if mark == "{":
                seen.add(start)
        elif mark in ("}", "]") and expected in (NEXT, FIRST_KEY if mark == "}" else FIRST_VALUE) and (open_starts[-1] >= 0) == (mark == "}"):
            opened = open_starts.pop()
            if opened >= 0:
                ends[opened] = place
            if not open_starts:
                return
            expected = NEXT
        elif mark == "," and expected == NEXT:
            expected = KEY if open_starts[-1] >= 0 else VALUE
        elif mark == ":" and expected == COLON:
            expected = VALUE
        elif string is not None and expected in (KEY, FIRST_KEY):
            expected = COLON
        elif (string is not None or word is not None) and expected in (VALUE, FIRST_VALUE):
            expected = NEXT
        else:
            return


#: So many braces are tried with the decoder of the json module, which is fast but starts anew at each.
_DECODED = 4
_decode = json.JSONDecoder().raw_decode


def first_object(text: str) -> str | None:
    """The first complete JSON object of a text, or none.

    Most reports have little noise, so their first braces go to the decoder. Behind these, a brace that an
    earlier object passed is not read again, whether its own object ended or not; so the time is linear also
    for texts full of braces and for deep objects that are never closed.
    """
    begin = text.find("{")
    for _ in range(_DECODED):
        if begin < 0:
            return None
        try:
            return text[begin : _decode(text, begin)[1]]
        except json.JSONDecodeError:
            begin = text.find("{", begin + 1)
        except (RecursionError, ValueError):  # too deep, or a number with too many digits
            break
    seen: set[int] = set()
    ends: dict[int, int] = {}
    while begin >= 0:
        if begin not in seen:
            _read_object(text, begin, seen, ends)
        if begin in ends:
            return text[begin : ends[begin]]
        begin = text.find("{", begin + 1)
    return None


@F.arrow_udf(StringType())
def _first_objects(texts: pa.Array, noisy: pa.Array = None) -> pa.Array:
    """The first objects of the texts; of texts that are not noisy, the texts themselves.

    Spark keeps each row that it sends to Python until the result is back, on disk where memory ends, and sends on as
    long as Python takes more. Only results that fill their connection make it stop: if clean texts came back as
    nulls, a task would keep all rows of its partition.
    """
    if noisy is not None and not pc.any(noisy).as_py():
        return texts.cast(pa.string())
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), pa.string())
    wanted = [True] * len(texts) if noisy is None else noisy.to_pylist()
    return pa.array([first_object(text) if want and text is not None else text for text, want in zip(texts.to_pylist(), wanted)], pa.string())


def recovered_json(text: Column) -> Column:
    """The first JSON object of a text; null when there is none.

    A text that is an object as a whole is parsed in the JVM and returned. Only noisy texts go to the
    brace scanner.
    """
    clean = F.ltrim(text)
    whole = F.when(clean.startswith("{") & F.try_parse_json(clean).isNotNull(), clean)
    return F.coalesce(whole, _first_objects(text, whole.isNull()))


def recover_json(logs: DataFrame, column: str = "stdout", result: str = "payload") -> DataFrame:
    return logs.withColumn(result, recovered_json(F.col(column)))


def load_reports(reports: DataFrame, tool: str) -> DataFrame:
    """Typed documents of one tool; ``readable`` is false for rows to quarantine.

    An empty report is a tool that found nothing: readable, without results. A clean report is parsed
    once, straight to its type; only what that parser marks as broken is recovered and parsed again.
    """
    ddl = REPORT_DDL[tool]
    text = F.ltrim(F.coalesce("payload", F.lit("")))
    text = F.when(F.trim(text) == "", F.lit("{}")).otherwise(text)
    parsed = F.from_json(F.when(text.startswith("{"), text), f"{ddl}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    fine = F.col("_parsed").isNotNull() & F.col("_parsed._broken").isNull()
    again = F.from_json("_part", ddl)
    return (
        reports.filter(F.col("tool") == tool)
        .withColumn("_parsed", parsed)
        .withColumn("_part", _first_objects("payload", ~fine))
        .withColumn("readable", fine | F.col("_part").isNotNull())
        .withColumn("document", F.when(fine, F.struct("_parsed.results")).otherwise(again))
        .drop("_parsed", "_part")
    )


def unreadable(loaded: DataFrame) -> DataFrame:
    return loaded.filter(~F.col("readable")).drop("document", "readable")
