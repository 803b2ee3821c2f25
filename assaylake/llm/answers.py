"""The shared view of model answers: where they are read from and what shape a text has."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions import deepjson
from assaylake.llm.wordlists import PLACEHOLDERS, STOPWORDS

# Characters that show nothing.
INVISIBLE = "​‌‍⁠﻿­"
# What collectors put behind a cut.
CUT_MARK = re.compile(r"[\s​]*(?:<cut>|<truncated>|\[\.\.\.\]|\[…\]|\[truncated\]|\(truncated\)|\(cut\)|…|\.\.\.|�)[\s​]*$", re.I)
# Sentence ends of the nine languages, and what may close behind them.
TERMINAL = ".!?。！？"
CLOSERS = "\"'”’»)]}*_」』）"
FENCE = re.compile(r"^\s*(?:`{3,})[^\n`]*(?:\n|$)", re.M)
LEAD = re.compile(r"^\s*(?:[A-Za-z]{2,12}:\s*)?(?=[{\[`])")
# Closing words, and the greetings behind which a name may stand.
CLOSING = re.compile(r"^(?:[-=*_#~]{3,}|\W*(?:(?:the )?end(?: of (?:the )?[\w-]+(?: [\w-]+)?)?|eof|ok|okay|done|finis|fin|fine|ende|fim|einde|конец|以上|終わり|完)\W*)$", re.I)
GREETING = re.compile(r"^(?:(?:best|kind|warm|many|with) )*(?:regards|thanks|thank you|sincerely|cheers|yours(?: \w+)?|(?:mit )?freundliche[nr]? grü(?:ß|ss)en?|cordialement|bien à vous|saludos(?: \w+)?|atentamente|atenciosamente|cumprimentos|cordiali saluti|distinti saluti|met vriendelijke groet(?:en)?|с уважением|敬具)\W*$", re.I)
ITEM = re.compile(r"^(?:[-*•·–]|\d{1,3}[.)])\s+(?=\S)")
LABELLED = re.compile(r"^(?P<label>[^\W\d][\w-]*(?: [\w-]+){0,3}):\s+(?P<value>\S+(?: \S+){0,5})$")
SIGNED = re.compile(r"^(?:--|—|–|~)\s*(?P<name>\S+(?: \S+){0,4})$")
LINKED = re.compile(r"^(?:\[\d+\]\s.*|.*\bhttps?://\S+)$")
_CLOSED_CLASS = {w for words in STOPWORDS.values() for w in words}


def closing_line(line: str, before: str) -> str:
    """Whether a last line without sentence end is complete: 'full', 'loose' (could be cut, too) or ''.

    Complete are closing words and rulers, signatures (a dash and a name, or a name behind a greeting), labelled values and
    references, and items of a list of which the item before has no sentence end either. None of them ends in a closed-class
    word, a single letter, a comma or a hyphen. A line is full if it ends in an identifier (with a digit or an underscore), is
    a closing word, a name in capitals, or a labelled item; others may as well be cut within their last word.
    """
    if CLOSING.match(line):
        return "full"
    if GREETING.match(line):
        return "loose"
    item = ITEM.match(line)
    body = line[item.end() :] if item else line
    labelled, signed = LABELLED.match(body), SIGNED.match(line)
    last = body.split()[-1] if body.split() else ""
    word = last.strip("\"'”’)]}")
    if not word or word[-1] in ",;:-/(" or (len(word) == 1 and word.isalpha()) or word.lower() in _CLOSED_CLASS:
        return ""
    identifier = any(c.isdigit() or c == "_" for c in word)
    if labelled:
        return "full" if identifier or (item and " " not in labelled["value"]) else "loose"
    if signed or GREETING.match(before):
        names = (signed["name"] if signed else line).split()
        return "full" if identifier or all(n[:1].isupper() for n in names) else "loose" if signed else ""
    if LINKED.match(line):
        return "full" if identifier else "loose"
    if item and ITEM.match(before) and not before.rstrip(CLOSERS + "`")[-1:] in TERMINAL:
        return "full" if identifier else "loose"
    return ""


def read_answers(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """One row per answer of both tables: tab, row_id, turn_no, source, text, repaired, prompt_hash and the named extra columns.

    repaired says that the answer's parsed value, where the table has one, was made by a repairing parser. Only the needed
    columns reach the scan. Null lists give no rows; null elements give a row with null text.
    """
    single = spark.read.parquet(f"{path}/run_artifacts.parquet")
    many = spark.read.parquet(f"{path}/pilot_runs.parquet")
    repaired = F.lit(False)
    if "parsed_output" in single.columns:
        repaired = F.coalesce(F.get_json_object("parsed_output", "$.repaired") == "true", F.lit(False))
    a = single.select(
        F.lit("run_artifacts").alias("tab"), F.col("artifact_id").cast("long").alias("row_id"), F.lit(0).cast("long").alias("turn_no"),
        "source", F.col("raw_output").alias("text"), repaired.alias("repaired"), "prompt_hash", *more,
    )
    b = many.select("run_id", "source", "prompt_hashes", F.posexplode("receiver_raw_outputs").alias("turn", "text"), *more).select(
        F.lit("pilot_runs").alias("tab"), F.col("run_id").cast("long").alias("row_id"), F.col("turn").cast("long").alias("turn_no"),
        "source", "text", F.lit(False).alias("repaired"), F.expr("try_element_at(prompt_hashes, turn + 1)").alias("prompt_hash"), *more,
    )
    return a.unionAll(b)


@dataclass(frozen=True)
class Shape:
    """What a text is: kind 'blank', 'json' or 'prose'; whether it ends whole; how sure that is."""

    kind: str
    whole: bool
    #: A last line that is whole in its loose form only: at a length limit it counts as cut.
    fragile: bool = False
    #: Why a text is not whole.
    reason: str = ""
    value: object = None


_DECODER = json.JSONDecoder()


def visible(text: str) -> str:
    """The text without surrounding white space and invisible characters."""
    return text.strip(" \t\r\n\f\v 　" + INVISIBLE)


def open_delimiters(text: str) -> tuple[list[str], bool]:
    """The delimiter stack left open at the end of a JSON-like text, and whether a string is open."""
    stack: list[str] = []
    inside = escaped = False
    for ch in text:
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "{[":
            stack.append(ch)
        elif ch in "}]":
            if stack:
                stack.pop()
            if not stack:
                break
    return stack, inside


def hollow(value: object) -> bool:
    """Whether a JSON value is nothing but empty structure."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)
        elif x is not None and not (isinstance(x, str) and not visible(x)):
            return False
    return True


def shape(text: str | None, repaired: bool = False) -> Shape:
    """Classify one answer; see Shape. Null and blank texts and placeholders are 'blank' and whole.

    A JSON value that doesn't parse is cut if a delimiter is open or if its parsed value had to be repaired.
    """
    body = visible(text or "")
    if not body or (len(body) < 24 and body.lower() in PLACEHOLDERS):
        return Shape("blank", True)
    lead = LEAD.match(body)
    start = lead.end() if lead else -1
    if start >= 0 and body[start : start + 3] == "```":
        fence = FENCE.match(body, start)
        start = fence.end() if fence else -1
        while 0 <= start < len(body) and body[start].isspace():
            start += 1
    if 0 <= start < len(body) and body[start] in "{[" and re.match(r"[{\[]\s*(?:[\"{\[\]}\d\-tfn]|$|\W*$)", body[start:]):
        try:
            try:
                value, _ = _DECODER.raw_decode(body, start)
            except RecursionError:
                value, _ = deepjson.deep_value(body, start)
        except ValueError:
            stack, inside = open_delimiters(body[start:])
            if stack or inside or repaired:
                return Shape("json", False, reason="json")
        else:
            if not isinstance(value, list) or not body[start:].startswith("[...]"):
                return Shape("blank" if hollow(value) else "json", True, value=value)
    return prose_shape(body)


def prose_shape(body: str) -> Shape:
    """Shape of a text that is no JSON: delimiter stack of fences first, then markers, last lines and sentence ends."""
    marked = CUT_MARK.search(body)
    if marked and marked.start() == 0:
        return Shape("prose", True)  # nothing but a placeholder
    cut = body[: marked.start()].rstrip() if marked else body
    if marked and marked.group().strip() not in ("...", "…"):
        return Shape("prose", False, reason="marker")
    fences = len(re.findall(r"^\s*```", cut, re.M))
    if fences % 2:
        return Shape("prose", False, reason="fence")
    last = cut.rsplit("\n", 1)[-1].strip()
    if last.startswith("```"):
        return Shape("prose", True)
    stripped = cut.rstrip(CLOSERS + "`")
    if marked:
        return Shape("prose", False, reason="marker")
    if stripped and stripped[-1] in TERMINAL:
        return Shape("prose", True)
    if "\n" in cut:
        complete = closing_line(last, cut.rstrip().rsplit("\n", 2)[-2].strip())
        if complete:
            return Shape("prose", True, fragile=complete == "loose")
    return Shape("prose", False, reason="sentence")
