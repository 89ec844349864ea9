"""The library's comparators and edits in SQL: temporary SQL functions, and a table function that makes a sample's edits. They are SQL
themselves, so that a query over them is one plan without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.interventions import CORRECTION, LOCAL

CHECKLIST = "ARRAY<STRUCT<item: STRING, pos: INT, answer: BOOLEAN>>"
_SET = "array_sort(transform({0}, x -> named_struct('item', x.item, 'answer', x.answer)))"

#: name -> (parameters, result, body); a result in parentheses is a table's.
FUNCTIONS = {
    "same_checklist": (f"a {CHECKLIST}, b {CHECKLIST}", "INT", f"CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST({_SET.format('a')} = {_SET.format('b')} AS INT) END"),
    "same_answer": ("a STRING, b STRING, dataset STRING", "BOOLEAN", "coalesce(CASE WHEN dataset = 'ricechem' THEN abs(try_cast(a AS DOUBLE) - try_cast(b AS DOUBLE)) <= "
                    "greatest(1e-9D * greatest(abs(try_cast(a AS DOUBLE)), abs(try_cast(b AS DOUBLE))), 0.01D) ELSE a = b END, false)"),
    "generation_status": (f"well_formed BOOLEAN, mediator {CHECKLIST}, gold {CHECKLIST}", "STRING",
                          f"CASE WHEN NOT well_formed OR mediator IS NULL THEN 'error' WHEN {_SET.format('mediator')} = {_SET.format('gold')} THEN 'correct' ELSE 'incorrect' END"),
    "checklist_edits": (f"mediator {CHECKLIST}, gold {CHECKLIST}, status STRING", f"TABLE (kind STRING, edit_no INT, edited {CHECKLIST})",
                        "SELECT e.kind, e.edit_no, e.edited FROM (SELECT explode(CASE status "
                        f"WHEN 'correct' THEN transform(mediator, (m, i) -> named_struct('kind', '{LOCAL}', 'edit_no', i, 'edited', transform(mediator, (x, j) -> named_struct('item', x.item, 'pos', x.pos, 'answer', CASE WHEN i = j THEN NOT x.answer ELSE x.answer END)))) "
                        f"WHEN 'incorrect' THEN array(named_struct('kind', '{CORRECTION}', 'edit_no', 0, 'edited', gold)) END) AS e)"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the functions known to a session; the names that they have there."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
