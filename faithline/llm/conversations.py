"""Repair of the turn structure of conversations by the cheapest edits.

A repaired conversation's role initials follow `(s?(ua)+)?`. Rows are numbered by one global sort (conversation, turn, digest), so a
long conversation lies in many tasks. Stretches of CHUNK numbered rows of a conversation are then reduced to a letter a row: its role and its first fault.

Backward: chunks stream by conversation from the last to the first; a chunk is told what each grammar state costs at its end, and passes on what each costs at its
start (Delete, Keep, Rerole and Insert as transitions). Forward: rows stream by conversation in order, each chunk's letters and end costs
before its rows; the walk takes the ASCII-least edit among those that the cheapest way allows, and the repaired lines go
straight into the hash. A task holds one chunk's costs and one row, never a conversation. A
digest of a whole conversation is a chain by its nature, so one conversation's lines pass through one task, in a sorted stream that may spill.

Defined results: nulls in role and text are one space, and in ``damaged``'s key too; rows of null turn come first; a null conversation is one like any
other; rows of one turn go by the SHA-256 of role and text, equal ones in any order; roles are told apart by their first character, as it is written; a conversation
without rows has zeros, an empty audit and the empty string's hash; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACE, own, table, written

#: Rows of a chunk, as a power of two.
CHUNK_BITS = 8
#: States: nothing yet, after system, after user, after assistant; what a user or assistant turn leads to from each.
NEXT, ACCEPTING = (2, 2, 3, 2), (0, 3)
NEVER = 1 << 40
#: Classes of roles by their first character (the last one: any other) and faults, as letters number them.
ROLES, FAULTS = "suax", ("sound", "blank", "duplicate", "truncated")


class Costs(NamedTuple):
    """What edits cost, and what an undeleted truncated row adds."""

    delete: int = 2
    insert: int = 5
    rerole: int = 1
    truncated: int = 5


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text: rows of which a hash of `conv:turn` drops, empties, cuts the stops of, doubles, or makes the user's a twentieth each."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    d = own(df, conv=F.col(f"`{conv}`"), turn=F.col(f"`{turn}`"), role=said(F.col(f"`{role}`")), text=said(F.col(f"`{text}`")))
    d = d.withColumn("k", F.crc32(F.concat(said(F.col("conv")), F.lit(":"), said(F.col("turn"))).cast("binary")) % 20).filter("k != 0")
    text_ = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"), copies.alias("copy")).drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, digest, pos: rows in the order of conversations and turns, numbered along it (with gaps), stored."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    each = rows.select("conv", "turn", "role", "text", digest.alias("digest"), F.monotonically_increasing_id().alias("salt"))  # the salt splits equal rows
    return written(each.orderBy("conv", "turn", "digest", "salt").drop("salt").withColumn("pos", F.monotonically_increasing_id()), "turns")


def _letter(fault: Column, role: Column) -> Column:
    """One letter for a role's class and a fault, from `a` on."""
    return F.chr(F.lit(97) + 4 * fault + F.when(role.isin(*ROLES[:3]), F.instr(F.lit(ROLES), role) - 1).otherwise(3))


def chunks(rows: DataFrame) -> DataFrame:
    """conv, chunk, letters: what the edits go by, for each stretch of a conversation's numbered rows, stored."""
    blank = ~F.col("text").rlike(rf"[^{SPACE}]")
    truncated = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    row = F.struct("pos", F.when(blank, 1).when(truncated, 3).otherwise(0).alias("fault"), F.substring("role", 1, 1).alias("role"))
    each = rows.select("conv", "pos", row.alias("row"))
    first = rows.groupBy("conv", "digest").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(None).cast(each.schema["row"].dataType).alias("row"))
    both = each.unionAll(first).groupBy("conv", F.shiftright("pos", CHUNK_BITS).alias("chunk"))
    found = both.agg(F.array_sort(F.collect_list("row")).alias("rows"), F.collect_set(F.when(F.col("row").isNull(), F.col("pos"))).alias("new"))
    fault = lambda r: F.when((r["fault"] != 1) & ~F.array_contains("new", r["pos"]), 2).otherwise(r["fault"])
    return written(found.select("conv", "chunk", F.array_join(F.transform("rows", lambda r: _letter(fault(r), r["role"])), "").alias("letters")), "chunks")


def with_inserts(costs: list[int], insert: int) -> tuple[int, ...]:
    """Costs of the states where turns may be inserted first; more than two bring nothing."""
    return tuple(min(costs[s], insert + costs[NEXT[s]], 2 * insert + costs[NEXT[NEXT[s]]]) for s in range(4))


def at_end(by: Costs) -> tuple[int, ...]:
    """What the states cost after the last row."""
    return with_inserts([0 if s in ACCEPTING else NEVER for s in range(4)], by.insert)


def edits(letter: str, state: int, after: tuple[int, ...], by: Costs) -> list[tuple[str, int, int]]:
    """(edit, cost of it and all that follows, next state) of a row in a state."""
    fault, role = divmod(ord(letter) - 97, 4)
    out = [("D", by.delete + after[state], state)]
    if fault in (0, 3):
        more = by.truncated if fault == 3 else 0
        to = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(ROLES[role])
        if to is not None:
            out.append(("K", more + after[to], to))
        out.append(("R", by.rerole + more + after[NEXT[state]], NEXT[state]))
    return out


@functools.lru_cache(maxsize=4096)
def backward(letters: str, end: tuple[int, ...], by: Costs) -> tuple[tuple[int, ...], ...]:
    """Costs of the states before each row of a chunk, given those at its end (which come last)."""
    out = [end]
    for letter in reversed(letters):
        out.append(with_inserts([min(cost for _, cost, _ in edits(letter, s, out[-1], by)) for s in range(4)], by.insert))
    return tuple(reversed(out))


@functools.lru_cache(maxsize=4096)
def forward(letters: str, end: tuple[int, ...], by: Costs, state: int) -> tuple[str, ...]:
    """For each row of a chunk entered in a state, the edits that inserts before it and the row itself take."""
    costs, out = backward(letters, end, by), []
    for i, letter in enumerate(letters):
        here = ""
        while not here or here[-1] == "I":
            options = [*edits(letter, state, costs[i + 1], by), ("I", by.insert + costs[i][NEXT[state]], NEXT[state])]
            edit, state = min((e, s) for e, cost, s in options if cost == costs[i][state])
            here += edit
        out.append(here)
    return tuple(out)


def costed(pieces: DataFrame, by: Costs) -> DataFrame:
    """conv, chunk, letters, ends: the chunks with the states' costs at their ends."""
    import pyarrow as pa

    def run(batches):
        conv, end, last = None, (), at_end(by)
        for b in batches:
            ends = []
            for c, letters in zip(b.column("conv").to_pylist(), b.column("letters").to_pylist(), strict=True):
                if not end or c != conv:
                    conv, end = c, last
                ends.append(list(end))
                end = backward(letters, end, by)[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.list_(pa.int64()))], names=[*b.schema.names, "ends"])

    down = pieces.repartition("conv").sortWithinPartitions("conv", F.desc("chunk")).select("conv", "chunk", "letters")
    return down.mapInArrow(run, f"conv {pieces.schema['conv'].dataType.simpleString()}, chunk long, letters string, ends array<long>")


class Walk:
    """A conversation in the forward pass."""

    def __init__(self, by: Costs):
        self.by, self.state, self.cost, self.audit, self.plan = by, 0, None, [], iter(())
        self.faults, self.illegal, self.last_role = [0] * len(FAULTS), 0, ""
        self.low = self.high = None
        self.turns, self.lines, self.sha = 0, 0, hashlib.sha256()

    def chunk(self, letters: str, ends: list[int]) -> None:
        if self.cost is None:
            self.cost = backward(letters, tuple(ends), self.by)[0][0]
        plan = forward(letters, tuple(ends), self.by, self.state)
        self.audit += plan
        self.plan = iter(plan)
        for letter in letters:
            fault, role = divmod(ord(letter) - 97, 4)
            self.faults[fault] += 1
            if self.last_role:
                self.illegal += self.last_role + ROLES[role] not in ("su", "ua", "au")
            self.last_role = ROLES[role]

    def line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.lines else "") + role + ":").encode())
        self.sha.update(text.encode())
        self.lines += 1

    def turned(self) -> str:
        """The role of a turn that is inserted or given another role."""
        self.state = NEXT[self.state]
        return "user" if self.state == 2 else "assistant"

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        for edit in next(self.plan):
            if edit == "I":
                self.line(self.turned(), "")
            elif edit == "R":
                self.line(self.turned(), text)
            elif edit == "K":
                self.state = 1 if role[:1] == "s" else NEXT[self.state]
                self.line(role, text)

    def result(self) -> tuple:
        while self.state not in ACCEPTING:
            self.audit.append("I")
            self.line(self.turned(), "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, self.cost or 0, "".join(self.audit), self.sha.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: DataFrame, conversations: DataFrame | None = None, conv_name: str = "conv_id", by: Costs = Costs()) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conversation of ``conversations`` (conv), or those of
    the rows (conv, turn, role, text)."""
    import pyarrow as pa

    rows = numbered(rows)
    kind = rows.schema["conv"].dataType.simpleString()
    none = {c.name: F.lit(None).cast(c.dataType).alias(c.name) for c in rows.schema}
    letters, ends = F.lit(None).cast("string").alias("letters"), F.lit(None).cast("array<long>").alias("ends")
    every = (rows if conversations is None else conversations).select("conv").distinct().select("conv", F.lit(-1).cast("long").alias("pos"), none["turn"], none["role"], none["text"], letters, ends)
    heads = costed(chunks(rows), by).select("conv", F.shiftleft("chunk", CHUNK_BITS).alias("pos"), none["turn"], none["role"], none["text"], "letters", "ends")
    lines = rows.select("conv", "pos", "turn", "role", "text", letters, ends)

    def run(batches):
        conv, walk = None, None
        for b in batches:
            done = []
            for c, pos, turn, role, text, letters, ends in zip(*(b.column(x) for x in ("conv", "pos", "turn", "role", "text", "letters", "ends")), strict=True):
                c = c.as_py()
                if walk is None or c != conv:
                    if walk is not None:
                        done.append((conv, *walk.result()))
                    conv, walk = c, Walk(by)
                if letters.is_valid:
                    walk.chunk(letters.as_py(), ends.as_py())
                elif pos.as_py() >= 0:
                    walk.row(turn.as_py(), role.as_py(), text.as_py())
            yield found(done)
        if walk is not None:
            yield found([(conv, *walk.result())])

    schema = f"`{conv_name}` {kind}, {RESULT}"
    types = [to_arrow_type(rows.schema["conv"].dataType), *[pa.int64()] * 6, pa.string(), pa.string()]

    def found(done):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=[conv_name, *(x.split()[0] for x in RESULT.split(", "))])

    stream = every.unionAll(heads).unionAll(lines).repartition("conv").sortWithinPartitions("conv", "pos", F.col("letters").isNull())
    return stream.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repaired(damaged(rows), own(rows, conv=F.col("conv_id")))


#: The same in DuckDB: crc32 bit by bit, costs backward and the walk forward as recursions over a conversation's rows.
ORACLE = r"""
WITH RECURSIVE src AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT) AS bytes FROM conversations),
hit AS (SELECT *, xor(list_reduce(bytes, lambda a, b: list_reduce(range(8)::BIGINT[], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)), 4294967295), 4294967295) % 20 AS k FROM src),
dmg AS (SELECT conv, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE k <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i FROM dmg),
flt AS (SELECT *, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS p,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS f FROM num),
agg AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(f = 1) AS blank, count_if(f = 2) AS duplicate, count_if(f = 3) AS truncated,
    count_if(p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv),
c0 AS (SELECT conv, n + 1 AS i, 0 AS a0, 10 AS a1, 5 AS a2, 0 AS a3 FROM agg
    UNION ALL SELECT conv, i, least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3, 10 + b2), least(b3, 5 + b2, 10 + b3) FROM (
        SELECT flt.conv, flt.i, least(2 + a0, CASE WHEN f IN (0, 3) THEN least(CASE r WHEN 's' THEN a1 WHEN 'u' THEN a2 ELSE 99999999 END, 1 + a2) + CASE f WHEN 3 THEN 5 ELSE 0 END ELSE 99999999 END) AS b0,
            least(2 + a1, CASE WHEN f IN (0, 3) THEN least(CASE r WHEN 'u' THEN a2 ELSE 99999999 END, 1 + a2) + CASE f WHEN 3 THEN 5 ELSE 0 END ELSE 99999999 END) AS b1,
            least(2 + a2, CASE WHEN f IN (0, 3) THEN least(CASE r WHEN 'a' THEN a3 ELSE 99999999 END, 1 + a3) + CASE f WHEN 3 THEN 5 ELSE 0 END ELSE 99999999 END) AS b2,
            least(2 + a3, CASE WHEN f IN (0, 3) THEN least(CASE r WHEN 'u' THEN a2 ELSE 99999999 END, 1 + a2) + CASE f WHEN 3 THEN 5 ELSE 0 END ELSE 99999999 END) AS b3
        FROM c0 JOIN flt ON flt.conv IS NOT DISTINCT FROM c0.conv AND flt.i = c0.i - 1) AS s),
cost AS (SELECT conv, i, [a0, a1, a2, a3] AS a FROM c0),
walk AS (SELECT conv, 1::BIGINT AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS lines FROM agg
    UNION ALL SELECT conv, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN s WHEN e = 'K' AND r = 's' THEN 1 WHEN s = 2 THEN 3 ELSE 2 END, audit || e,
        CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || CASE e WHEN 'R' THEN text ELSE '' END) END FROM (
        SELECT w.*, x.role, x.text, x.r, CASE
            WHEN x.i IS NOT NULL AND here.a[s + 1] = 2 + nxt.a[s + 1] THEN 'D'
            WHEN here.a[s + 1] = 5 + here.a[CASE WHEN s = 2 THEN 4 ELSE 3 END] THEN 'I'
            WHEN x.f IN (0, 3) AND ((x.r = 's' AND s = 0) OR (x.r = 'u' AND s <> 2) OR (x.r = 'a' AND s = 2))
                 AND here.a[s + 1] = nxt.a[CASE x.r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END] + CASE x.f WHEN 3 THEN 5 ELSE 0 END THEN 'K'
            ELSE 'R' END AS e
        FROM walk w JOIN cost here ON here.conv IS NOT DISTINCT FROM w.conv AND here.i = w.i
            LEFT JOIN flt x ON x.conv IS NOT DISTINCT FROM w.conv AND x.i = w.i LEFT JOIN cost nxt ON nxt.conv IS NOT DISTINCT FROM w.conv AND nxt.i = w.i + 1
        WHERE x.i IS NOT NULL OR s IN (1, 2)) AS t),
fin AS (SELECT w.conv, audit, sha256(array_to_string(lines, chr(10))) AS sha FROM walk w JOIN agg ON agg.conv IS NOT DISTINCT FROM w.conv WHERE w.i = n + 1 AND s IN (0, 3))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(cost.a[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN agg ON agg.conv IS NOT DISTINCT FROM o.conv_id LEFT JOIN cost ON cost.conv IS NOT DISTINCT FROM o.conv_id AND cost.i = 1
    LEFT JOIN fin ON fin.conv IS NOT DISTINCT FROM o.conv_id
"""
