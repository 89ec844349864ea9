"""Tools as a model calls them: their specifications, checks of arguments, and what a completion says, by tool mode.

Modes: 'none' (the answer stands in the text), 'simple' (a tool call with a text) and 'structured' (a tool call with values)."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import structures, text

MODES = ("none", "simple", "structured")


def _spec(name: str, says: str, argument: str, kind: dict, returns: str) -> str:
    return json.dumps({"name": name, "description": says, "parameters": {"type": "object", "properties": {argument: kind}, "required": [argument]}, "returns": returns}, ensure_ascii=False)


_TEXT = lambda says: {"type": "string", "description": says}
_BOOLS = {"type": "array", "items": {"type": "boolean"}, "description": "one truth value for each item, in the order of the items"}
#: (dataset, mode) -> the tool's description for a prompt.
SPECS = {
    ("ricechem", "simple"): _spec("score", "Adds up the weights of the rubric items that hold.", "rubric", _TEXT("the checklist, a line for each item"), "number"),
    ("ricechem", "structured"): _spec("score", "Adds up the weights of the rubric items that hold.", "rubric", _BOOLS, "number"),
    ("averitec", "simple"): _spec("verdict", "Tells whether a claim is supported by the answers to its questions.", "rubric", _TEXT("the checklist, a line for each question"), "Supported or Refuted"),
    ("averitec", "structured"): _spec("verdict", "Tells whether a claim is supported by the answers to its questions.", "rubric", _BOOLS, "Supported or Refuted"),
    ("tabfact", "simple"): _spec("run_query", "Runs a query on the table.", "query", _TEXT("a query that ends in =True or =False"), "boolean"),
    ("cruxeval", "simple"): _spec("replay", "Evaluates what the function returns after the last step of a trace.", "trace", _TEXT("the trace, in lines"), "text"),
    ("cruxeval", "structured"): _spec("replay", "Evaluates what the function returns after the last step of a trace.", "trace", {"type": "array", "items": {"type": "object", "properties": {"line": {"type": "integer"}, "locals": {"type": "object"}}, "required": ["line", "locals"]}}, "text"),
}


def valid_bools(answers: Column) -> Column:
    """Whether a list of truth values is one: not empty and without gaps."""
    return F.coalesce((F.size(answers) > 0) & F.forall(answers, lambda x: x.isNotNull()), F.lit(False))


def valid_checklist(checklist: Column) -> Column:
    return F.coalesce((F.size(checklist) > 0) & F.forall(checklist, lambda x: (F.length(x["item"]) > 0) & x["answer"].isNotNull()), F.lit(False))


def valid_query(query: Column) -> Column:
    return F.coalesce(query.endswith("=True") | query.endswith("=False"), F.lit(False))


def valid_trace(trace: Column) -> Column:
    """Whether every step of a trace has a line and locals (there may be none)."""
    return F.coalesce(F.forall(trace, lambda s: s["line"].isNotNull() & s["locals"].isNotNull()), F.lit(False))


def valid_trace_text(trace: Column) -> Column:
    return F.coalesce(F.length(F.trim(trace)) > 0, F.lit(False))


def called_checklist(completion: Column, gold: Column, mode: str, style: str, short: bool = False) -> Column:
    """The checklist of a tool call; null without a valid one. Positions stand for the gold checklist's items."""
    if mode == "none":
        return F.lit(None).cast("array<struct<item:string,pos:int,answer:boolean>>")
    if mode == "structured":
        return text.let(text.bool_list(completion, short=short), lambda a: F.when(valid_bools(a), text.bools_to_checklist(a, gold)))
    return text.let(text.tool_checklist(completion, style, short=short), lambda c: F.when(valid_checklist(c), c))


def graded(completion: Column, gold: Column, weights: Column, mode: str = "none", short: bool = False) -> tuple[Column, Column]:
    """(score, checklist of the tool call) that a completion of a grading task comes to."""
    call = called_checklist(completion, gold, mode, "rubric", short)
    return (text.final_grade(completion, short) if mode == "none" else text.let(call, lambda c: structures.rubric_score(c, weights))), call


def judged(completion: Column, gold: Column, gold_verdict: Column, mode: str = "none", short: bool = False) -> tuple[Column, Column]:
    """(verdict, checklist of the tool call) that a completion of a claim task comes to."""
    call = called_checklist(completion, gold, mode, "question", short)
    return (text.final_verdict(completion, short) if mode == "none" else text.let(call, lambda c: structures.verdict(c, gold, gold_verdict))), call


def queried(completion: Column, mode: str = "none", short: bool = False) -> tuple[Column, Column]:
    """(result said, query of the tool call) of a table task. With a tool, the result is what ``dsl.text_tables.verdicts`` gives for the query."""
    if mode == "none":
        return text.execution_result(completion, short), F.lit(None).cast("string")
    query = text.tool_query(completion, short)
    return F.lit(None).cast("boolean"), F.when(valid_query(query), query)


def answered(completion: Column, short: bool = False) -> Column:
    """The answer said in a completion of a program task. With a tool, see ``trace.tool_answers``."""
    return text.final_answer(completion, short)
