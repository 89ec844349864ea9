"""The table-query language's operators: canonical names, aliases and arity bounds."""

from __future__ import annotations

UNBOUNDED = None

#: Name -> (fewest, most arguments).
ARITY: dict[str, tuple[int, int | None]] = (
    dict.fromkeys(("eq", "not_eq", "greater", "less", "hop", "max", "min", "uniq", "most_freq", "diff", "add", "before", "after",
                   "first", "second", "third", "fourth", "fifth", "last", "rank"), (2, 2))
    | dict.fromkeys(("and", "or"), (2, UNBOUNDED))
    | dict.fromkeys(("not", "top", "bottom", "count", "half", "any", "none", "only", "zero"), (1, 1))
    | dict.fromkeys(("filter_eq", "filter_not_eq", "filter_greater", "filter_greater_eq", "filter_less", "filter_less_eq",
                     "within", "not_within", "any_eq", "all_not_eq", "all_greater_eq", "all_less", "all_less_eq"), (3, 3))
    | dict.fromkeys(("argmax", "argmin", "sum", "avg"), (1, 2))
    | dict.fromkeys(("all_eq", "all_greater"), (2, 3))
)

#: Other spellings.
ALIASES = {"equal": "eq", "ne": "not_eq", "neq": "not_eq", "gt": "greater", "more_than": "greater", "lt": "less", "filter_equal": "filter_eq", "filter_ne": "filter_not_eq"}


def canonical(name: str) -> str:
    return ALIASES.get(name, name)
