"""JSON arguments of tool calls: the object that a text begins with, whatever follows it.

One pass over the pieces of the text (strings, brackets, the rest) keeps the depth and the length so far, and so finds where the object
closes; ``try_parse_json`` says whether that is JSON. Nothing leaves the JVM, and the state of the pass is three numbers. Numbers that JSON does
not have (NaN, Infinity) and repeated keys make no JSON here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dsl.values import strip
from .text import _found, _unfenced

_PIECES = r'(?s)"(?:[^"\\]++|\\.)*+"?|[{}\[\]]|[^"{}\[\]]++'
#: JSON that is no object: a string, a number, a word.
_OTHER = r'(?s)^(?:"(?:[^"\\]++|\\.)*+"|-?[0-9]|true|false|null|NaN|-?Infinity)'


def closed_sql(x: str) -> str:
    """A text up to where the bracket that it begins with closes; empty if it never does."""
    step = ("named_struct('depth', a.depth + CASE WHEN p IN ('{', '[') THEN 1 WHEN p IN ('}', ']') THEN -1 ELSE 0 END, 'size', a.size + length(p), "
            "'end', CASE WHEN a.end = 0 AND a.depth = 1 AND p IN ('}', ']') THEN a.size + length(p) ELSE a.end END)")
    return f"left({x}, aggregate(regexp_extract_all({x}, r'{_PIECES}', 0), named_struct('depth', 0, 'size', 0, 'end', 0), (a, p) -> {step}, a -> a.end))"


def block(text: Column, short: bool = False) -> Column:
    """What follows ARGS: (or a short text as it is), without fences."""
    return strip(_unfenced(strip(text if short else _found(text, r"(?is)\bARGS\s*:\s*(.*)$"))))


def object_of(block_name: str) -> Column:
    """The JSON object that a column's text begins with, or that begins at its first brace if the text begins with no JSON; null if there is none."""
    begins = f"CASE WHEN NOT {block_name} RLIKE r'{_OTHER}' AND NOT (startswith({block_name}, '[') AND try_parse_json({closed_sql(block_name)}) IS NOT NULL) AND instr({block_name}, '{{') > 0 THEN substring({block_name}, instr({block_name}, '{{')) END"
    found = f"transform(array({begins}), b -> {closed_sql('b')})"
    return F.expr(f"get(filter({found}, o -> try_parse_json(o) IS NOT NULL), 0)")


def trace_kind(object_name: str) -> Column:
    """'text' or 'steps', by what a JSON object has under trace; null for anything else."""
    kind = f"schema_of_variant(try_variant_get(try_parse_json({object_name}), '$.trace', 'variant'))"
    return F.expr(f"CASE WHEN {kind} = 'STRING' THEN 'text' WHEN {kind} LIKE 'ARRAY<%' THEN 'steps' END")


def trace_text(object_name: str) -> Column:
    return F.when(trace_kind(object_name) == "text", F.expr(f"try_variant_get(try_parse_json({object_name}), '$.trace', 'string')"))


def trace_lines(object_name: str) -> Column:
    """The line numbers of the steps, as texts."""
    return F.when(trace_kind(object_name) == "steps", F.expr(f"transform(try_variant_get(try_parse_json({object_name}), '$.trace', 'array<variant>'), s -> try_variant_get(s, '$.line', 'string'))"))
