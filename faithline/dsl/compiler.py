"""Programs as grouped plans over a family of tables.

A family is a DataFrame with key columns, a column that orders a table's rows and cells; a program runs on the table of every key. Row sets
become boolean columns, and everything that looks at one becomes an aggregate under that condition, so a program is
one ``groupBy(keys).agg(...)`` and a projection, with partial aggregation, no list of rows and no order but minima and maxima.

Where rows are compared with a value that their own table gives (a filter by an average, the second row of a set, a row's number), the plan has phases:
the value is aggregated, joined back to the rows (``phases.joined_back``, salted where a table is hot) and looked at by the next phase's aggregates. All values
of a phase come from one aggregation, and equal expressions are one. Errors are values: every node carries a condition under which it fails, and a program is
executable if none holds."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parser import Call, Literal, Node, Program, ProgramError, parse_expr, parse_program
from .phases import Hot, hot_tables, joined_back
from .registry import ARITY
from .values import bare_number_sql, bare_text_sql, norm_text, parse_number, quoted, strict_sql, strip, strip_sql

_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


@dataclass
class Field:
    """A column of a family's tables: its cells, as Columns of the rows."""

    key: object  # names the column in the keys of aggregates
    raw: Column  # text, never null
    numeric: Column | None = None  # the cells as numbers, where some are stored so
    known: Column | None = None  # whether the row's table has the column; None: every table has it
    plain: bool = False  # cells are numbers, no texts
    # given by the compiler, which makes columns of the rows only for what is asked
    made: Callable[[str], Column] | None = None

    @property
    def number(self) -> Column:
        return self.made("number")

    @property
    def text(self) -> Column:
        return self.made("text")


@dataclass(frozen=True)
class Family:
    """A DataFrame of tables: ``keys`` name a table, ``row`` orders its rows without ties, ``columns`` are its cells. Where ``dense``,
    ``row`` numbers a table's rows from 0."""

    df: DataFrame
    keys: tuple[str, ...]
    row: str = "__row"
    columns: tuple[str, ...] | None = None
    dense: bool = True

    def names(self) -> dict[str, str]:
        cells = self.columns or tuple(c for c in self.df.columns if c not in (*self.keys, self.row))
        return {c.strip().lower(): c for c in cells}

    def stored(self) -> list[str]:
        """The columns that cells come from."""
        return list(self.names().values())

    def over(self, df: DataFrame, keys: tuple[str, ...]) -> Family:
        """The same cells in another DataFrame, where tables may have more keys."""
        return Family(df, keys, self.row, tuple(self.names().values()), self.dense)

    def field(self, name: str | Column) -> Field:
        """The column of a name: one that is known when the plan is made, or one that each row may have another of."""
        types = dict(self.df.dtypes)
        if isinstance(name, str):
            key = name.strip().lower()
            c = self.names().get(key)
            if c is None:
                return Field(key, F.lit(""), known=F.lit(False))
            plain = types[c].startswith(_NUMERIC)
            return Field(key, F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).cast("double") if plain else None, plain=plain)
        wanted, every = F.lower(strip(name)), self.names()
        raw = F.coalesce(*[F.when(wanted == k, F.col(c).cast("string")) for k, c in every.items()], F.lit(""))
        numbers = [F.when(wanted == k, F.col(c).cast("double")) for k, c in every.items() if types[c].startswith(_NUMERIC)]
        return Field(str(name), raw, F.coalesce(*numbers) if numbers else None, wanted.isin(*every))


@dataclass(frozen=True)
class Ragged(Family):
    """Tables that need not have the same columns: a row holds its table's ``names`` (normal form) and its ``cells``, and a column is looked up
    in each row. Of equal names the last one counts."""

    header: str = "__names"
    cells: str = "__cells"

    def stored(self) -> list[str]:
        return [self.header, self.cells]

    def over(self, df: DataFrame, keys: tuple[str, ...]) -> Ragged:
        return Ragged(df, keys, self.row, None, self.dense, self.header, self.cells)

    def field(self, name: str | Column) -> Field:
        key, wanted = (name.strip().lower(), F.lit(name.strip().lower())) if isinstance(name, str) else (str(name), F.lower(strip(name)))
        before_last = F.array_position(F.reverse(self.header), wanted)
        raw = F.coalesce(F.get(self.cells, F.when(before_last > 0, F.size(self.header) - before_last).cast("int")), F.lit(""))
        return Field(key, raw, known=before_last > 0)


class Fails(Exception):
    """The program fails whatever the data."""


@dataclass
class Value:
    kind: str  # rows, row, text, number, bool, or hop: cells of a row set, a scalar if that has one row
    col: Column | None = None  # of a scalar, or a row's place in the family's order, by table
    error: Column | None = None
    literal: object = None
    needs: frozenset[str] = frozenset()  # the aggregates that col and error are made of; none: it holds for rows and tables alike
    # a text's number and normal form, where they are there already
    number: Column | None = None
    text: Column | None = None
    # rows: the condition, the phase whose rows have all that it takes, and how many columns of rows are made one from another for it
    where: Column | None = None
    phase: int = 0
    depth: int = 0
    hint: Field | None = None
    # row: the cell of this row
    pick: Callable[[Field], Column] | None = None
    # hop over rows
    rows: Value | None = None
    column: Field | None = None
    # names this value in the keys of aggregates; an address could be another value's later on
    uid: int = field(default_factory=itertools.count().__next__)


def _any(*errors: Column | None) -> Column | None:
    found = [e for e in errors if e is not None]
    return reduce(lambda a, b: a | b, found) if found else None


class Compiler:
    """The aggregates of programs over a family. ``literal`` gives the Value of a literal that is no word of the language;
    ``derived`` adds the columns that follow from a table's keys (its rows have them already), ``hot`` are the large tables where they are known."""

    def __init__(self, family: Family, literal: Callable[[str], Value] | None = None, derived: Callable[[DataFrame], DataFrame] = lambda tables: tables, hot: Hot | None = None):
        self.family, self.derived, self.hot = family, derived, hot
        self.literal = literal or (lambda raw: Value("text", F.lit(raw), literal=raw))
        self.row = F.col(family.row)
        self.base = F.lit(True)  # the rows that all_rows has
        self.aggs: dict[str, tuple[Column, int]] = {}
        self.seen: dict[object, str] = {}
        self.back: dict[str, tuple[Column, int, frozenset[str]]] = {}  # values that are joined back: (value, phase that gives it, its aggregates)
        self.made: dict[object, tuple[str, Column, int, int]] = {}  # columns of the rows: (name, Column, phase, depth)
        self.kept: dict[object, str] = {}
        self.of_tables: dict[str, tuple[Column, frozenset[str], int]] = {}  # columns of the tables made from aggregates: (Column, what it needs, depth)
        self.touched: set[str] = set()
        self.values: dict[object, Value] = {}
        self.fields: dict[object, Field] = {}

    def scope(self, name: object, base: Column) -> None:
        """From here on a program whose tables are told by ``base``."""
        self.base, self.values = base, {}

    # aggregates and phases

    def agg(self, key: object, column: Column, phase: int) -> Column:
        name = self.seen.get(key)
        if name is None:
            name = self.seen[key] = f"__a{len(self.seen)}"
            self.aggs[name] = (column, phase)
        self.touched.add(name)
        return F.col(name)

    def of_rows(self, key: object, make: Callable[[], Column], phase: int, depth: int) -> Column:
        """A column of the rows of a phase that is worked out once and used in several places; ``depth`` orders columns made from others."""
        if key not in self.made:
            self.made[key] = (f"__c{len(self.made)}", make(), phase, depth)
        return F.col(self.made[key][0])

    def phase_of(self, needs: Iterable[str]) -> int:
        return max((self.aggs[n][1] for n in needs if n in self.aggs), default=0)

    def once(self, key: object, v: Value, make: Callable[[], Column]) -> Column:
        """A Column made of a table's value that is worked out once and used in several places."""
        if key not in self.kept:
            outer, self.touched = self.touched, set(v.needs)
            col, needs = make(), frozenset(self.touched)
            self.touched = outer
            name = self.kept[key] = f"__t{len(self.kept)}"
            self.of_tables[name] = (col, needs, 1 + max((self.of_tables[n][2] for n in needs if n in self.of_tables), default=0))
        name = self.kept[key]
        self.touched |= {name} | self.of_tables[name][1]
        return F.col(name)

    def at_rows(self, v: Value, make: Callable[[], Column]) -> tuple[Column, int]:
        """A Column made of a table's value, for its rows, and the phase whose rows have it."""
        outer, self.touched = self.touched, set(v.needs)
        col = make()
        needs = frozenset(self.touched)
        self.touched = outer | needs
        if not needs:
            return col, 0
        name = f"__v{len(self.back)}"
        phase = self.phase_of(needs)
        self.back[name] = (col, phase, needs)
        return F.col(name), phase + 1

    def grouped(self, needs: Iterable[str]) -> DataFrame:
        """The tables' keys with the aggregates of these names."""
        df, keys, wanted = self.family.df, self.family.keys, set(needs)

        def with_columns(df: DataFrame, phase: int) -> DataFrame:
            mine = [m for m in self.made.values() if m[2] == phase]
            for depth in sorted({m[3] for m in mine}):
                df = df.withColumns({m[0]: m[1] for m in mine if m[3] == depth})
            return df

        def grouped(df: DataFrame, names: Iterable[str]) -> DataFrame:
            aggs = [self.aggs[n][0].alias(n) for n in sorted(names) if n in self.aggs]
            tables = self.derived(df.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("__n")])))
            mine = {n: self.of_tables[n] for n in names if n in self.of_tables}
            for depth in sorted({m[2] for m in mine.values()}):
                tables = tables.withColumns({n: m[0] for n, m in mine.items() if m[2] == depth})
            return tables
        df = with_columns(df, 0)
        for phase in sorted({b[1] for b in self.back.values()}):
            here = {n: v for n, v in self.back.items() if v[1] == phase}
            names = frozenset().union(*(v[2] for v in here.values()))
            tables = grouped(df, names).select(*keys, *[col.alias(n) for n, (col, _, _) in here.items()])
            self.hot = self.hot or hot_tables(self.family.df, keys)
            df = with_columns(joined_back(df, tables, keys, self.family.row, self.hot), phase + 1)
        return grouped(df, wanted)

    # scalars

    def scalar(self, v: Value) -> Value:
        """A hop as the scalar it is if its row set has one row."""
        if v.kind == "hop":
            outer, self.touched = self.touched, set(v.needs)
            out = Value("text", self.first_cell(v), _any(v.error, self.count(v.rows) != 1))
            out.needs = frozenset(self.touched)
            self.touched = outer | out.needs
            return out
        if v.kind == "rows":
            return Value("text", F.lit(None).cast("string"), F.lit(True))
        return v

    def to_number(self, v: Value) -> Column:
        if v.number is not None:
            return v.number
        if isinstance(v.literal, str):
            return parse_number(quoted(v.literal))
        if v.kind == "number":
            return v.col.cast("double")
        if v.kind == "row":
            return self.row_number(v).cast("double")
        if v.kind == "text":
            return self.once(("number of", v.uid), v, lambda: parse_number(self.named(v)))
        return F.lit(None).cast("double")

    def to_text(self, v: Value) -> Column:
        if v.text is not None:
            return v.text
        if isinstance(v.literal, str):
            return norm_text(quoted(v.literal))
        return self.once(("text of", v.uid), v, lambda: norm_text(self.named(v)))

    def named(self, v: Value) -> str:
        """The name of a table's column that holds a value as text."""
        self.once(("named", v.uid), v, lambda: (self.row_number(v) if v.kind == "row" else v.col).cast("string"))
        return self.kept["named", v.uid]

    def row_number(self, v: Value) -> Column:
        """A row's number in its table: how many rows are before it."""
        if v.number is not None:
            return v.number
        if self.family.dense:
            return v.col
        place, phase = self.at_rows(v, lambda: v.col)
        return self.agg(("number", v.uid), F.sum(F.when(place.isNotNull(), (self.row < place).cast("long"))), phase)

    def count(self, rows: Value) -> Column:
        return self.agg(("count", rows.uid), F.count_if(rows.where), rows.phase)

    def first_cell(self, hop: Value) -> Column:
        w = hop.rows.where
        return self.agg(("cell", hop.rows.uid, hop.column.key), F.min_by(F.when(w, hop.column.raw), F.when(w, self.row)), hop.rows.phase)

    @staticmethod
    def same(na: Column, ta: Column, nb: Column, tb: Column) -> Column:
        return F.when(na.isNotNull() & nb.isNotNull(), (na == nb) & ~F.isnan(na)).otherwise(ta == tb)

    @staticmethod
    def ordered(op: str, a: Column, b: Column) -> Column:
        got = {"greater": a > b, "greater_eq": a >= b, "less": a < b, "less_eq": a <= b}[op]
        return got & ~F.isnan(a) & ~F.isnan(b)

    # evaluation

    def eval(self, node: Node) -> Value:
        """A node's value; equal nodes are one value, and so are their aggregates."""
        v = self.values.get(node)
        if v is None:
            outer, self.touched = self.touched, set()
            v = self._literal(node) if isinstance(node, Literal) else self._call(node)
            v.needs = frozenset(self.touched)
            self.touched = outer
            self.values[node] = v
        self.touched |= v.needs
        return v

    def _literal(self, node: Literal) -> Value:
        raw = node.text.strip()
        if raw == "all_rows":
            return Value("rows", where=self.base)
        if raw.lower() in ("true", "false"):
            return Value("bool", F.lit(raw.lower() == "true"), literal=raw.lower() == "true")
        if len(raw) >= 2 and raw[0] == raw[-1] == '"':
            raw = raw[1:-1]
        return self.literal(raw)

    def _call(self, node: Call) -> Value:
        if node.name not in ARITY:
            raise Fails(f"unknown operator {node.name}")
        args = [self.eval(a) for a in node.args]
        least, most = ARITY[node.name]
        if len(args) < least or (most is not None and len(args) > most):
            raise Fails(f"{node.name} takes {least} to {most} arguments, not {len(args)}")
        error = _any(*(a.error for a in args))
        out = getattr(self, f"do_{node.name.partition('_')[0]}" if node.name.startswith(("filter_", "all_")) else f"do_{node.name}")(node.name, *args)
        out.error = _any(error, out.error)
        return out

    def rowset(self, v: Value) -> Value:
        if v.kind != "rows":
            raise Fails("a row set is asked for")
        return v

    def field_of(self, v: Value) -> Field:
        """The column that a value names."""
        if v.kind in ("rows", "hop"):
            raise Fails("a column's name is asked for")
        name, phase = (str(v.literal), 0) if v.literal is not None else self.at_rows(v, lambda: v.col.cast("string"))
        return self.cells(name, phase)

    def cells(self, name: str | Column, phase: int = 0) -> Field:
        key = name.strip().lower() if isinstance(name, str) else str(name)
        if key not in self.fields:
            f = self.family.field(name)
            f.raw = self.of_rows((key, "raw"), lambda: f.raw, phase, 0)
            f.known = f.known if f.known is None else self.of_rows((key, "known"), lambda: f.known, phase, 0)
            name = self.made[key, "raw"][0]

            def made(what: str) -> Column:
                if what == "number" and f.plain:
                    return self.of_rows((key, what), lambda: f.numeric, phase, 2)
                self.of_rows((key, "bare"), lambda: F.expr(strip_sql(name)), phase, 1)
                bare = self.made[key, "bare"][0]
                if what == "text":
                    return self.of_rows((key, what), lambda: F.expr(bare_text_sql(bare)), phase, 2)
                parsed = lambda: F.expr(bare_number_sql(bare))
                return self.of_rows((key, what), parsed if f.numeric is None else lambda: F.coalesce(f.numeric, parsed()), phase, 2)
            f.made = made
            self.fields[key] = f
        return self.fields[key]

    def unknown(self, c: Value, f: Field) -> Column | None:
        """An unknown column fails as soon as a row is visited."""
        if f.known is None:
            return None
        return (self.count(c) > 0) & ~F.coalesce(self.agg(("known", f.key), F.bool_or(f.known), 0), F.lit(False))

    def row_of(self, v: Value) -> Value:
        if v.kind == "row":
            return v
        if v.kind == "rows":
            return self.do_top("top", v)
        if v.kind == "bool":  # the row of number 0 or 1
            if self.family.dense:
                return Value("row", v.col.cast("long"), needs=v.needs)
            first = Value("row", self.agg("first row", F.min(self.row), 0), needs=frozenset([self.seen["first row"]]))
            at, phase = self.at_rows(first, lambda: first.col)
            second = self.agg("second row", F.min(F.when(self.row > at, self.row)), phase)
            return Value("row", F.when(v.col, second).otherwise(first.col), number=v.col.cast("long"), needs=v.needs | first.needs | {self.seen["second row"]})
        raise Fails("a row is asked for")

    # filters

    def compared(self, c: Value, v: Value, texts: bool) -> tuple[Column, Column | None, Column | None, int]:
        """(number, text, error, phase) of a value that cells of a row set are compared with. That it is no scalar fails, in
        comparisons of texts, with the first row; in others it is no number."""
        error = None
        if v.kind in ("hop", "rows"):
            v = self.scalar(v)
            if texts:
                error = v.error & (self.count(c) > 0)
            else:
                v = Value("text", F.when(v.error, F.lit(None)).otherwise(v.col), needs=v.needs)
        m, phase = self.at_rows(v, lambda: self.to_number(v))
        t, later = self.at_rows(v, lambda: self.to_text(v)) if texts else (None, 0)
        return m, t, error, max(phase, later)

    def do_filter(self, name: str, c: Value, f: Value, v: Value) -> Value:
        c, f, op = self.rowset(c), self.field_of(f), name.removeprefix("filter_")
        m, t, error, phase = self.compared(c, v, op in ("eq", "not_eq"))
        if op in ("eq", "not_eq"):
            hit = self.same(f.number, f.text, m, t)
            hit = hit if op == "eq" else ~hit
        else:
            hit = self.ordered(op, f.number, m)
        known = F.lit(True) if f.known is None else f.known
        out = Value("rows", hint=f, error=_any(error, self.unknown(c, f)), phase=max(c.phase, phase), depth=max(c.depth, 2) + 1)
        out.where = self.of_rows(("where", out.uid), lambda: c.where & known & F.coalesce(hit, F.lit(False)), out.phase, out.depth)
        return out

    # comparisons, logic, arithmetic

    def do_eq(self, name: str, a: Value, b: Value) -> Value:
        a, b = self.scalar(a), self.scalar(b)
        hit = self.same(self.to_number(a), self.to_text(a), self.to_number(b), self.to_text(b))
        return Value("bool", hit if name == "eq" else ~hit, _any(a.error, b.error))

    do_not_eq = do_eq

    def _both(self, a: Value, b: Value) -> tuple[Column, Column, Column]:
        a, b = self.scalar(a), self.scalar(b)
        x, y = self.to_number(a), self.to_number(b)
        return x, y, _any(a.error, b.error, x.isNull() | y.isNull())

    def do_greater(self, name: str, a: Value, b: Value) -> Value:
        x, y, error = self._both(a, b)
        return Value("bool", self.ordered(name, x, y), error)

    do_less = do_greater

    def do_add(self, name: str, a: Value, b: Value) -> Value:
        x, y, error = self._both(a, b)
        return Value("number", x + y if name == "add" else x - y, error)

    do_diff = do_add

    def do_zero(self, name: str, a: Value) -> Value:
        a = self.scalar(a)
        n = self.to_number(a)
        return Value("bool", n == 0, _any(a.error, n.isNull()))

    def truth(self, v: Value) -> Column:
        if v.kind == "bool":
            return v.col
        if v.kind in ("number", "row"):
            return F.coalesce((v.col if v.kind == "number" else self.row_number(v)) != 0, F.lit(False))
        if v.kind == "text":
            return F.length(v.col) > 0
        if v.kind == "hop":
            return (self.count(v.rows) != 1) | (F.length(self.first_cell(v)) > 0)
        return F.lit(True)

    def do_and(self, name: str, *args: Value) -> Value:
        return Value("bool", reduce(lambda a, b: a & b, map(self.truth, args)))

    def do_or(self, name: str, *args: Value) -> Value:
        return Value("bool", reduce(lambda a, b: a | b, map(self.truth, args)))

    def do_not(self, name: str, a: Value) -> Value:
        return Value("bool", ~self.truth(a))

    # navigation

    def do_hop(self, name: str, base: Value, f: Value) -> Value:
        f = self.field_of(f)
        if base.kind == "rows":
            return Value("hop", rows=base, column=f, error=self.unknown(base, f))
        every = self.eval(Literal("all_rows"))
        if base.kind == "bool":
            base = self.row_of(base)
        if base.kind != "row":
            raise Fails("hop takes a row or row set, and a column")
        if base.pick is not None:
            return Value("text", F.coalesce(base.pick(f), F.lit("")), self.unknown(every, f))
        at, phase = self.at_rows(base, lambda: base.col)
        got = self.agg(("at", base.uid, f.key), F.max(F.when(self.row == at, f.raw)), phase)
        return Value("text", got, _any(got.isNull(), self.unknown(every, f)))

    def _extreme(self, c: Value, f: Field, largest: bool) -> Value:
        """First row of the largest or smallest number; a NaN is taken only if it is the first number."""
        n = f.number
        counts = c.where & n.isNotNull()
        by = F.struct(-n if largest else n, self.row)
        key = ("extreme", c.uid, f.key, largest)

        def of(what: Column, tag: object) -> Column:
            best = self.agg((*key, tag), F.min_by(what, F.when(counts & ~F.isnan(n), by)), c.phase)
            if f.plain:
                return best
            first = self.agg((*key, tag, "first"), F.min_by(what, F.when(counts, self.row)), c.phase)
            return F.when(self.agg((*key, "nan"), F.min_by(F.isnan(n), F.when(counts, self.row)), c.phase), first).otherwise(best)
        row = of(self.row, "row")
        return Value("row", row, _any(row.isNull(), self.unknown(c, f)), pick=lambda g: of(g.raw, g.key))

    def do_argmax(self, name: str, c: Value, f: Value | None = None) -> Value:
        c = self.rowset(c)
        f = c.hint if f is None else self.field_of(f)
        if f is None:
            raise Fails(f"{name} needs a field")
        return self._extreme(c, f, name == "argmax")

    do_argmin = do_argmax

    def do_top(self, name: str, c: Value) -> Value:
        c = self.rowset(c)
        choose, key = (F.min_by, "top") if name == "top" else (F.max_by, "bottom")
        at = F.when(c.where, self.row)
        row = self.agg((key, c.uid), (F.min if name == "top" else F.max)(at), c.phase)
        return Value("row", row, row.isNull(), pick=lambda f: self.agg((key, c.uid, f.key), choose(f.raw, at), c.phase))

    do_bottom = do_top

    def do_before(self, name: str, a: Value, b: Value) -> Value:
        numbers = a.kind == "bool" or b.kind == "bool"  # rows that may not be there have no place
        a, b = self.row_of(a), self.row_of(b)
        x, y = (self.row_number(a), self.row_number(b)) if numbers else (a.col, b.col)
        return Value("bool", x < y if name == "before" else x > y, _any(a.error, b.error))

    do_after = do_before

    def _nth(self, name: str, c: Value, d: Value) -> Value:
        """Is a row the one with so many of the set before it? It is known by its place, so its rank is a count."""
        k = ("first", "second", "third", "fourth", "fifth").index(name)
        c, d = self.rowset(c), self.row_of(d)
        if k == 0:
            return Value("bool", F.coalesce(self.do_top("top", c).col == d.col, F.lit(False)), d.error)
        at, phase = self.at_rows(d, lambda: d.col)
        phase = max(phase, c.phase)
        ahead = self.agg(("ahead", c.uid, d.uid), F.count_if(c.where & (self.row < at)), phase)
        member = self.agg(("member", c.uid, d.uid), F.bool_or(c.where & (self.row == at)), phase)
        return Value("bool", F.coalesce(member, F.lit(False)) & (ahead == k), d.error)

    do_first = do_second = do_third = do_fourth = do_fifth = _nth

    def do_last(self, name: str, c: Value, d: Value) -> Value:
        c, d = self.rowset(c), self.row_of(d)
        return Value("bool", F.coalesce(self.do_top("bottom", c).col == d.col, F.lit(False)), d.error)

    def do_rank(self, name: str, c: Value, f: Value) -> Value:
        c, f = self.rowset(c), self.field_of(f)
        top, best = self.do_top("top", c), self._extreme(c, self.cells("rank"), False)
        return Value("text", F.coalesce(F.when(best.col.isNotNull(), best.pick(f)).otherwise(top.pick(f)), F.lit("")), _any(top.error, self.unknown(c, f)))

    # aggregates

    def do_count(self, name: str, c: Value) -> Value:
        n = self.count(self.rowset(c)).cast("double")
        return Value("number", n / 2 if name == "half" else n)

    do_half = do_count

    def listed(self, v: Value) -> tuple[Value, Field, Column]:
        """(row set, column, error) of a list: a hop, unless its row set has exactly one row."""
        if v.kind != "hop":
            raise Fails("a list is asked for")
        return v.rows, v.column, _any(v.error, self.count(v.rows) == 1)

    def do_sum(self, name: str, c: Value, f: Value | None = None) -> Value:
        error = None
        if f is None:
            c, f, error = self.listed(c)
            f.number  # its cell without blanks is a column now
            n, key = F.expr(strict_sql(f"replace({self.made[f.key, 'bare'][0]}, ',', '')")), f"{name} of a list"
        else:
            c, f = self.rowset(c), self.field_of(f)
            n, key, error = f.number, name, self.unknown(c, f)
        got = self.agg((key, c.uid, f.key), {"sum": F.sum, "avg": F.avg}[name](F.when(c.where, n)), c.phase)
        return Value("number", F.coalesce(got, F.lit(0.0)), error) if name == "sum" else Value("number", got, _any(error, got.isNull()))

    do_avg = do_sum

    def do_max(self, name: str, c: Value, f: Value) -> Value:
        c, f = self.rowset(c), self.field_of(f)
        if f.plain:
            got = self.agg((name, c.uid, f.key), (F.max if name == "max" else F.min)(F.when(c.where, f.number)), c.phase)
            return Value("number", got, got.isNull())
        best = self._extreme(c, f, name == "max")
        return Value("number", self.to_number(Value("text", best.pick(f), needs=best.needs)), best.error)

    do_min = do_max

    def do_uniq(self, name: str, c: Value, f: Value) -> Value:
        c, f = self.rowset(c), self.field_of(f)
        t, error = F.when(c.where, f.text), self.unknown(c, f)
        if name == "uniq":
            return Value("number", self.agg(("uniq", c.uid, f.key), F.count_distinct(t), c.phase).cast("double"), error)
        got = self.agg(("mode", c.uid, f.key), F.mode(t, True), c.phase)
        return Value("text", got, _any(error, got.isNull()))

    do_most_freq = do_uniq

    # membership and quantifiers

    def do_within(self, name: str, c: Value, f: Value, v: Value) -> Value:
        c, f = self.rowset(c), self.field_of(f)
        m, t, error, phase = self.compared(c, v, True)
        hit = F.bool_or(c.where & self.same(f.number, f.text, m, t))
        got = F.coalesce(self.agg(("within", c.uid, f.key, v.uid), hit, max(phase, c.phase)), F.lit(False))
        return Value("bool", ~got if name == "not_within" else got, _any(error, self.unknown(c, f)))

    do_not_within = do_any_eq = do_within

    def do_any(self, name: str, v: Value) -> Value:
        if v.kind == "rows":
            got = self.count(v) > 0
        elif v.kind == "hop":
            n = self.count(v.rows)
            got = F.when(n == 1, self._blank(self.first_cell(v))).otherwise(n > 0)
        else:
            got = self._blank(v.col) if v.kind == "text" else F.lit(True)
        return Value("bool", ~got if name == "none" else got)

    do_none = do_any

    @staticmethod
    def _blank(c: Column) -> Column:
        return c.rlike(r"(?U)[^\s]")

    def do_only(self, name: str, c: Value) -> Value:
        return Value("bool", self.count(self.rowset(c)) == 1)

    def do_all(self, name: str, c: Value, f: Value, v: Value | None = None) -> Value:
        """Every cell of a row set, or of a list, against a value. Comparisons of numbers stop at the first row that decides: one that fails the test,
        or one that cannot be compared, which is an error; so the first of either is all that is kept."""
        op = name.removeprefix("all_")
        if v is None:
            v = f
            c, f, error = self.listed(c)
        else:
            c, f = self.rowset(c), self.field_of(f)
            error = self.unknown(c, f)
        m, t, wrong, phase = self.compared(c, v, op in ("eq", "not_eq"))
        phase, key, error = max(phase, c.phase), (name, c.uid, f.key, v.uid), _any(error, wrong)
        if op in ("eq", "not_eq"):
            hit = self.same(f.number, f.text, m, t)
            got = self.agg(key, F.bool_and(F.when(c.where, hit if op == "eq" else ~hit)), phase)
            return Value("bool", F.coalesce(got, F.lit(True)), error)
        bad = f.number.isNull() | m.isNull()
        fails = self.agg((*key, "no"), F.min(F.when(c.where & ~bad & ~F.coalesce(self.ordered(op, f.number, m), F.lit(False)), self.row)), phase)
        breaks = self.agg((*key, "bad"), F.min(F.when(c.where & bad, self.row)), phase)
        return Value("bool", fails.isNull(), _any(error, F.coalesce(breaks < fails, breaks.isNotNull())))


def truth_of(c: Compiler, p: Program) -> Value:
    """A program's value; one that is no truth value fails."""
    v = c.eval(p.expr)
    if v.kind != "bool":
        raise Fails("no truth value")
    return v


def runs(v: Value) -> Column:
    return F.lit(True) if v.error is None else ~F.coalesce(v.error, F.lit(False))


def run(program: str | Program, family: Family) -> DataFrame:
    """The family's keys with final, expr_value, expected and executable for every table."""
    none, keys = F.lit(None).cast("boolean"), list(family.keys)
    try:
        p = parse_program(program) if isinstance(program, str) else program
        c = Compiler(family)
        v = truth_of(c, p)
    except (ProgramError, Fails):
        return family.df.select(*keys).distinct().select(*keys, none.alias("final"), none.alias("expr_value"), none.alias("expected"), F.lit(False).alias("executable"))
    ok = runs(v)
    value = F.when(ok, F.coalesce(v.col, F.lit(False)))
    return c.grouped(v.needs).select(*keys, (value == p.expected).alias("final"), value.alias("expr_value"), F.when(ok, F.lit(p.expected)).alias("expected"), ok.alias("executable"))


def evaluate(node_text: str, family: Family) -> DataFrame:
    """The family's keys with the value of a scalar expression, as text, number or boolean, and executable."""
    c = Compiler(family)
    v = c.scalar(c.eval(parse_expr(node_text)))
    if v.kind == "row":
        v = Value("number", c.row_number(v), v.error)
    ok = runs(v)
    return c.grouped(c.touched).select(*family.keys, F.when(ok, v.col).alias("value"), ok.alias("executable"))
