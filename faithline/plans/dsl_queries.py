"""One query for each operator of the table language, over every user's or order's table, with the same in SQL.

Each entry: family, program, the SQL value of its expression by group, and the SQL condition under which it can be run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..dsl.compiler import run
from . import families

CLICK, BUY = "event_type = 'click'", "event_type = 'purchase'"
_CK = "filter_eq{all_rows; event_type; click}"
_R = "filter_eq{all_rows; l_returnflag; R}"
_ISR = "l_returnflag = 'R'"
_TOPV = "arg_max(r, {'v': value, 'r': -r})"
_LOWV = "arg_min(r, {'v': value, 'r': r})"


def _on(cond: str, agg: str = "count(*)") -> str:
    return f"({agg} FILTER (WHERE {cond}))"


def _kth(cond: str, k: int) -> str:
    return f"list(r ORDER BY r) FILTER (WHERE {cond})[{k}]"


CATALOGUE: dict[str, tuple[str, str, str, str]] = {
    "dsl_filter_eq": ("ev", "eq{count{" + _CK + "}; 14}=True", f"{_on(CLICK)} = 14", "true"),
    "dsl_filter_not_eq": ("ev", "eq{count{filter_not_eq{all_rows; event_type; click}}; 50}=True", f"{_on(f'NOT {CLICK}')} = 50", "true"),
    "dsl_filter_greater": ("ev", "greater{count{filter_greater{all_rows; value; 50}}; 20}=True", f"{_on('value > 50')} > 20", "true"),
    "dsl_filter_greater_eq": ("li", "eq{count{filter_greater_eq{all_rows; l_quantity; 25}}; 2}=True", f"{_on('l_quantity >= 25')} = 2", "true"),
    "dsl_filter_less": ("ev", "less{count{filter_less{all_rows; value, 10}}; 20}=True", f"{_on('value < 10')} < 20", "true"),
    "dsl_filter_less_eq": ("li", "eq{count{filter_less_eq{all_rows; l_quantity; 25}}; 2}=False", f"{_on('l_quantity <= 25')} = 2", "true"),
    "dsl_eq": ("li", "eq{hop{top{all_rows}; l_returnflag}; hop{bottom{all_rows}; l_returnflag}}=True", "arg_min(l_returnflag, r) = arg_max(l_returnflag, r)", "true"),
    "dsl_not_eq": ("li", "ne{hop{top{all_rows}; l_linestatus}; \"o\"}=True", "lower(arg_min(l_linestatus, r)) <> 'o'", "true"),
    "dsl_greater": ("ev", "greater{hop{argmax{" + _CK + "; value}; value}; avg{all_rows; value}}=True",
                    f"{_on(CLICK, 'max(value)')} > avg(value)", f"{_on(CLICK)} > 0"),
    "dsl_less": ("li", "lt{min{all_rows; l_quantity}; 5}=True", "min(l_quantity) < 5", "true"),
    "dsl_and": ("ev", "and{greater{count{" + _CK + "}; 10}; within{all_rows; event_type; purchase}}=True", f"{_on(CLICK)} > 10 AND {_on(BUY)} > 0", "true"),
    "dsl_or": ("li", "or{only{all_rows}; within{all_rows; l_returnflag; A}}=True", f"count(*) = 1 OR {_on(chr(39).join(['l_returnflag = ', 'A', '']))} > 0", "true"),
    "dsl_not": ("li", "not{only{all_rows}}=True", "count(*) <> 1", "true"),
    "dsl_diff": ("li", "greater{diff{max{all_rows; l_quantity}; min{all_rows; l_quantity}}; 20}=True", "max(l_quantity) - min(l_quantity) > 20", "true"),
    "dsl_add": ("li", "greater{add{max{all_rows; l_quantity}; min{all_rows; l_quantity}}; 50}=True", "max(l_quantity) + min(l_quantity) > 50", "true"),
    "dsl_zero": ("li", "zero{count{" + _R + "}}=True", f"{_on(_ISR)} = 0", "true"),
    "dsl_hop": ("li", "eq{hop{" + _R + "; l_linestatus}; F}=True", f"{_on(_ISR, 'min(l_linestatus)')} = 'F'", f"{_on(_ISR)} = 1"),
    "dsl_argmax": ("ev", "eq{hop{argmax{all_rows; value}; event_type}; click}=True", f"arg_max(event_type, {{'v': value, 'r': -r}}) = 'click'", "true"),
    "dsl_argmin": ("ev", "eq{hop{argmin{filter_greater{all_rows; value; 20}}; event_type}; click}=True",
                   f"{_on('value > 20', chr(39).join(['arg_min(event_type, {', 'v', ': value, ', 'r', ': r})']))} = 'click'", f"{_on('value > 20')} > 0"),
    "dsl_top": ("ev", "eq{hop{top{" + _CK + "}; value}; hop{top{all_rows}; value}}=True", f"{_on(CLICK, 'arg_min(value, r)')} = arg_min(value, r)", f"{_on(CLICK)} > 0"),
    "dsl_bottom": ("ev", "greater{hop{bottom{" + _CK + "}; value}; 50}=True", f"{_on(CLICK, 'arg_max(value, r)')} > 50", f"{_on(CLICK)} > 0"),
    "dsl_before": ("ev", "before{argmax{all_rows; value}; argmin{all_rows; value}}=True", f"{_TOPV} < {_LOWV}", "true"),
    "dsl_after": ("ev", "after{" + _CK + "; filter_eq{all_rows; event_type; purchase}}=True", f"{_on(CLICK, 'min(r)')} > {_on(BUY, 'min(r)')}", f"{_on(CLICK)} > 0 AND {_on(BUY)} > 0"),
    "dsl_first": ("ev", "first{" + _CK + "; argmax{" + _CK + "; value}}=True", f"{_on(CLICK, 'min(r)')} = {_on(CLICK, _TOPV)}", f"{_on(CLICK)} > 0"),
    **{f"dsl_{w}": ("li", w + "{all_rows; argmax{all_rows; l_extendedprice}}=True", f"arg_max(r, {{'v': l_extendedprice, 'r': -r}}) = {k}", "true")
       for k, w in ((1, "second"), (2, "third"), (3, "fourth"), (4, "fifth"))},
    "dsl_last": ("li", "last{" + _R + "; bottom{all_rows}}=True", f"coalesce({_on(_ISR, 'max(r)')} = max(r), false)", "true"),
    "dsl_rank": ("li", "eq{rank{all_rows; l_returnflag}; N}=True", "arg_min(l_returnflag, r) = 'N'", "true"),
    "dsl_count": ("ev", "eq{count{all_rows}; 64}=True", "count(*) = 64", "true"),
    "dsl_sum": ("li", "greater{sum{" + _R + "; l_quantity}; 60}=True", f"coalesce({_on(_ISR, 'sum(l_quantity)')}, 0) > 60", "true"),
    "dsl_avg": ("li", "greater{avg{" + _R + "; l_quantity}; 25}=True", f"{_on(_ISR, 'avg(l_quantity)')} > 25", f"{_on(_ISR)} > 0"),
    "dsl_max": ("li", "greater{max{" + _R + "; l_quantity}; 40}=True", f"{_on(_ISR, 'max(l_quantity)')} > 40", f"{_on(_ISR)} > 0"),
    "dsl_min": ("ev", "less{min{" + _CK + "; value}; 5}=True", f"{_on(CLICK, 'min(value)')} < 5", f"{_on(CLICK)} > 0"),
    "dsl_uniq": ("li", "eq{uniq{all_rows; l_returnflag}; 2}=True", "count(DISTINCT lower(l_returnflag)) = 2", "true"),
    "dsl_most_freq": ("ev", "eq{most_freq{all_rows; event_type}; click}=True",
                      "(SELECT min(t) FROM c WHERE c.user_id = ev.user_id AND n = (SELECT max(n) FROM c AS d WHERE d.user_id = ev.user_id)) = 'click'", "true"),
    "dsl_half": ("li", "less{half{all_rows}; count{" + _R + "}}=True", f"count(*) / 2 < {_on(_ISR)}", "true"),
    "dsl_within": ("li", "within{" + _R + "; l_linestatus; F}=True", f"{_on(_ISR + chr(39).join([' AND l_linestatus = ', 'F', '']))} > 0", "true"),
    "dsl_not_within": ("ev", "not_within{filter_greater{all_rows; value; 100}; event_type; click}=True", f"{_on(CLICK + ' AND value > 100')} = 0", "true"),
    "dsl_any_eq": ("li", "any_eq{all_rows; l_quantity; 7}=True", f"{_on('l_quantity = 7')} > 0", "true"),
    "dsl_any": ("li", "any{" + _R + "}=True", f"{_on(_ISR)} > 0", "true"),
    "dsl_none": ("li", "none{hop{" + _R + "; l_linestatus}}=True", f"{_on(_ISR)} = 0", "true"),
    "dsl_only": ("li", "only{" + _R + "}=True", f"{_on(_ISR)} = 1", "true"),
    "dsl_all_eq": ("li", "all_eq{" + _R + "; l_linestatus; F}=True", f"coalesce({_on(_ISR, 'bool_and(l_linestatus = ' + chr(39) + 'F' + chr(39) + ')')}, true)", "true"),
    "dsl_all_not_eq": ("li", "all_not_eq{all_rows; l_returnflag; R}=True", f"{_on(_ISR)} = 0", "true"),
    "dsl_all_greater": ("li", "all_greater{all_rows; l_quantity; 5}=True", "min(l_quantity) > 5", "true"),
    "dsl_all_greater_eq": ("li", "all_greater_eq{all_rows; l_quantity; 5}=True", "min(l_quantity) >= 5", "true"),
    "dsl_all_less": ("li", "all_less{" + _R + "; l_quantity; 45}=True", f"coalesce({_on(_ISR, 'max(l_quantity)')} < 45, true)", "true"),
    "dsl_all_less_eq": ("li", "all_less_eq{" + _R + "; l_quantity; 45}=True", f"coalesce({_on(_ISR, 'max(l_quantity)')} <= 45, true)", "true"),
    "dsl_list_forms": ("li", "all_eq{hop{" + _R + "; l_linestatus}; F}=True", f"coalesce({_on(_ISR, 'bool_and(l_linestatus = ' + chr(39) + 'F' + chr(39) + ')')}, true)", f"{_on(_ISR)} <> 1"),
    "dsl_not_executable": ("li", "count{all_rows}=True", "true", "false"),
    "dsl_missing_column": ("li", "within{" + _R + "; no such column; x}=True", "false", f"{_on(_ISR)} = 0"),
}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    kind, program, _, _ = CATALOGUE[name]

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(program, families.events(spark, sf_dir) if kind == "ev" else families.lines(spark, sf_dir))
    return go


def oracle(name: str) -> str:
    kind, program, value, runs = CATALOGUE[name]
    rows, key, source = (families.EV, "user_id", "ev") if kind == "ev" else (families.LI, "l_orderkey", "li")
    expected = "true" if program.endswith("True") else "false"
    counts = ", c AS (SELECT user_id, lower(event_type) AS t, count(*) AS n FROM ev GROUP BY ALL)" if " FROM c " in value else ""
    return (f"WITH {rows}{counts}, g AS (SELECT {key}, ({value}) AS v, ({runs}) AS ok FROM {source} GROUP BY {key}) "
            f"SELECT {key}, CASE WHEN ok THEN v = {expected} END AS final, CASE WHEN ok THEN v END AS expr_value, CASE WHEN ok THEN {expected} END AS expected, ok AS executable FROM g")


#: A filter whose value is computed from the same table: the users' largest click against the other events.
STRATIFIED = "greater{count{filter_greater{all_rows; value; hop{argmax{" + _CK + "; value}; value}}}; 0}=True"


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(STRATIFIED, families.events(spark, sf_dir))


STRATIFIED_SQL = (f"WITH {families.EV}, m AS (SELECT user_id, max(value) FILTER (WHERE {CLICK}) AS m FROM ev GROUP BY user_id), "
                  "g AS (SELECT ev.user_id, any_value(m) IS NOT NULL AS ok, count(*) FILTER (WHERE value > m) > 0 AS v FROM ev JOIN m USING (user_id) GROUP BY ev.user_id) "
                  "SELECT user_id, CASE WHEN ok THEN v END AS final, CASE WHEN ok THEN v END AS expr_value, CASE WHEN ok THEN true END AS expected, ok AS executable FROM g")

QUERIES = {name: query(name) for name in CATALOGUE} | {"dsl_nested_stratified": stratified}
ORACLES = {name: oracle(name) for name in CATALOGUE} | {"dsl_nested_stratified": STRATIFIED_SQL}
