"""Personal data by weak supervision.

Candidate spans come from base patterns (whose valid matches always stay) and from wider ones, secrets among them. Three labelers vote yes,
no or nothing on every candidate: a strict format check, a gazetteer (mail domains, calling codes, issuer and address
ranges, forms of keys) and the words around the span. For each kind, expectation-maximisation estimates how often the data are
personal and how reliable each labeler is, from the counts of vote patterns over all candidates; the posteriors are the
soft labels of a logistic span classifier over votes and shape, which alone decides on the wider candidates. Both fits see the
corpus only as counts by pattern, of which there is a fixed number.

Spans are found in the row: matches are set off by a private character, a split at it gives them and the gaps between
them, and a running sum of lengths over a document's own spans gives code-point positions. Patterns start only where a
run starts or the last match ended and repeat possessively, so very long words cost linear time.

All built-in functions. Defined results: a null text is empty (no spans); repeated rows give a row each; an empty table
gives an empty result; other columns are ignored."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, table, written

KINDS = ("email", "ip", "card", "phone")  # with base patterns
ALL_KINDS = (*KINDS, "secret")
MARK, SPARE = "", ""  # the second takes the first's place where a text holds it; no pattern matches either

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDER = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++ ?[\[(]at[\])] ?{_HOST}++(?: ?(?:\.|[\[(]dot[\])]) ?{_HOST}++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z])(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|(?:access|private|secret)[_-]?key)[\"']?[ \t]*[:=][ \t]*[\"']?[A-Za-z0-9+/_.~-]{8,}+=*[\"']?"
              r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
}
#: Texts that can't match are not searched.
GATE = {"email": r"[\[(]at[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", "card": r"[0-9]{15}|[0-9]{4}[ -][0-9]{4}", "phone": r"[0-9]{3}[ .-][0-9]{4}",
        "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|key)[\"']?[ \t]*[:=]|AKIA|gh[pousr]_|eyJ|-----BEGIN"}
#: Fixed values of the gazetteer and context labelers.
TLDS = "com|net|org|edu|gov|io|info|biz|co|de|fr|es|it|uk|us|eu|nl|ch|at|be|pl|ru|cn|jp|br|in|au|ca"
CALLING = "1|7|20|27|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
NEAR = {"email": "mail|contact|write to", "ip": r"\bip\b|host|server|address|login", "card": "card|visa|credit|debit|payment", "phone": "phone|tel|call|mobile|fax", "secret": "export|config|login|credential|auth|header"}
AGAINST = {"email": "git clone|scp ", "ip": "version|release|section|build", "card": "isbn|serial|order|build|sha", "phone": "isbn|order|serial|version", "secret": "example|placeholder|changeme|your[_ -]"}
AROUND = 32


def _spans(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<i, gap, value, before, after>> of the matches in a text free of MARK."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))

    def take(p: Column) -> Column:
        one = lambda i: F.struct(
            i.alias("i"), F.length(p[i - 1]).alias("gap"), p[i].alias("value"), F.right(p[i - 1], F.lit(AROUND)).alias("before"), F.substring(p[i + 1], 1, AROUND).alias("after"))
        return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), one))
    return let(F.split(marked, MARK, -1), take)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.reverse(F.filter(F.split(digits, ""), lambda x: x != ""))
    each = F.transform(d, lambda x, i: let(x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda y: F.when(y > 9, y - 9).otherwise(y)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    """The base checks of a match."""
    n = F.length(_digits(v))
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(v, r"\."), lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= "255")))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(v))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, kind, base (a base pattern's match), ok (its checks pass), start, stop, value, before, after."""
    text = F.replace(F.col(text_col), F.lit(MARK), F.lit(SPARE))
    d = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"), text.alias("t")).filter(F.col("t").rlike("[0-9]|@|" + GATE["email"]) | F.col("t").rlike(GATE["secret"]))
    found = []
    for rank, kind in enumerate(ALL_KINDS):
        gate = {"email": F.col("t").contains("@"), "phone": F.col("t").contains("+")}.get(kind, F.lit(True))
        if kind in BASE:
            found.append(F.struct(F.lit(rank).alias("kind"), F.lit(True).alias("base"), F.when(gate, _spans(F.col("t"), BASE[kind])).alias("s")))
        found.append(F.struct(F.lit(rank).alias("kind"), F.lit(False).alias("base"), F.when(F.col("t").rlike(GATE[kind]), _spans(F.col("t"), WIDER[kind])).alias("s")))
    d = d.select("doc_id", "row", F.explode(F.array(*found)).alias("f")).filter("f.s is not null").select("doc_id", "row", "f.kind", "f.base", F.explode("f.s").alias("s"))
    d = d.select("doc_id", "row", "kind", "base", "s.*").dropDuplicates(["row", "kind", "base", "i"])
    so_far = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row", "kind", "base").orderBy("i"))
    ok = reduce(lambda a, k: a.when(F.col("kind") == k[0], _valid(k[1], F.col("value"))), enumerate(KINDS), F.when(F.lit(False), F.lit(False)))
    d = d.withColumns({"stop": so_far.cast("long"), "start": (so_far - F.length("value")).cast("long"), "ok": F.when(F.col("base"), ok).otherwise(F.lit(False))})
    # short runs of digits are nobody's card
    return d.filter((F.col("kind") != KINDS.index("card")) | ~F.col("base") | (F.length(_digits(F.col("value"))) >= 13)).drop("i", "gap")


def votes(spans: DataFrame) -> DataFrame:
    """Adds the labelers' votes (1, -1, 0) as v_format, v_gazetteer, v_context, and shape (a small integer)."""
    v, digits = F.col("value"), _digits(F.col("value"))
    n = F.length(digits)
    yes = lambda c: F.when(c, 1).otherwise(-1)
    of = lambda by: reduce(lambda a, k: a.when(F.col("kind") == k[0], by[k[1]]), enumerate(ALL_KINDS), F.when(F.lit(False), 0)).cast("int")
    strict = {
        "email": yes(v.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(@|[\[(]at[\])]) ?.*[A-Za-z]{2,}$") & ~v.contains("..")),
        "ip": yes(F.when(v.contains(":"), F.lit(True)).otherwise(_valid("ip", v))),
        "card": yes(n.between(13, 19) & F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False))),
        "phone": yes(n.between(10, 15)),
        "secret": yes(v.rlike(r"[A-Za-z0-9+/_.~-]{16,}|-----BEGIN") & v.rlike("[0-9]|-----BEGIN")),
    }
    known = {
        "email": yes(F.lower(v).rlike(rf"(\.|dot[\])]) ?({TLDS})$")),
        "ip": F.when(v.contains(":"), 0).otherwise(yes(~v.rlike(r"^(0|127|22[4-9]|2[3-5][0-9])\."))),
        "card": yes(digits.rlike("^(3[4-7]|4|5[1-5]|2[2-7]|6)")),
        "phone": F.when(v.startswith("+"), yes(digits.rlike(f"^({CALLING})"))).otherwise(yes(digits.rlike("^[2-9]"))),
        "secret": yes(v.rlike(r"(?<![0-9a-fA-F])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})(?![0-9a-fA-F])|AKIA|gh[pousr]_|eyJ|-----BEGIN")),
    }
    words = F.lower(F.concat_ws(" ", "before", "after"))
    context = {k: F.when(words.rlike(NEAR[k]), 1).when(words.rlike(AGAINST[k]), -1).otherwise(0) for k in ALL_KINDS}
    shape = F.when(F.col("base"), 1).otherwise(0) + F.when(v.rlike("[ ().-]"), 2).otherwise(0) + F.when(n > 12, 4).otherwise(0)
    return spans.withColumns({"v_format": of(strict), "v_gazetteer": of(known), "v_context": of(context), "shape": shape})


LABELERS = ("v_format", "v_gazetteer", "v_context")


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, list[dict[bool, dict[int, float]]], dict[tuple[int, ...], float]]:
    """EM over (votes, count): prior of the positive class, P(vote | class) of each labeler, posterior of each pattern."""
    post = {v: min(0.9, max(0.1, 0.5 + 0.2 * sum(v))) for v, _ in patterns}
    prior, tables = 0.5, []
    for _ in range(rounds):
        total = sum(c for _, c in patterns)
        prior = (sum(post[v] * c for v, c in patterns) + 1) / (total + 2)
        tables = []
        for i in range(len(LABELERS)):
            by = {True: {-1: 1.0, 0: 1.0, 1: 2.0}, False: {-1: 2.0, 0: 1.0, 1: 1.0}}  # smoothed towards labelers better than chance
            for v, c in patterns:
                by[True][v[i]] += post[v] * c
                by[False][v[i]] += (1 - post[v]) * c
            tables.append({k: {x: y / sum(t.values()) for x, y in t.items()} for k, t in by.items()})
        for v in post:
            yes = math.log(prior) + sum(math.log(t[True][x]) for t, x in zip(tables, v, strict=True))
            no = math.log(1 - prior) + sum(math.log(t[False][x]) for t, x in zip(tables, v, strict=True))
            post[v] = 1 / (1 + math.exp(max(-700, min(700, no - yes))))
    return prior, tables, post


def _features(v: tuple[int, ...], shape: int) -> list[float]:
    return [1.0, *[float(x == 1) for x in v], *[float(x == -1) for x in v], *[float(shape >> b & 1) for b in range(3)]]


def classifier(rows: list[tuple[tuple[int, ...], int, float, float]], steps: int = 300) -> list[float]:
    """Logistic weights from (votes, shape, soft label, count), by gradient descent with a small ridge."""
    total = sum(r[3] for r in rows) or 1.0
    data = [(_features(v, s), y, c / total) for v, s, y, c in rows]
    w = [0.0] * (1 + 2 * len(LABELERS) + 3)
    for _ in range(steps):
        g = [1e-3 * x for x in w]
        for f, y, c in data:
            e = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, f, strict=True)))) - y
            for i, x in enumerate(f):
                g[i] += c * e * x
        w = [a - 2.0 * b for a, b in zip(w, g, strict=True)]
    return w


def fit(voted: DataFrame) -> dict[int, list[float]]:
    """kind -> classifier weights; the driver sees at most 27 vote patterns by 8 shapes for each kind."""
    counts = voted.groupBy("kind", *LABELERS, "shape").count().collect()
    out = {}
    for kind in range(len(ALL_KINDS)):
        mine = [((r.v_format, r.v_gazetteer, r.v_context), r["shape"], float(r["count"])) for r in sorted(counts) if r.kind == kind]
        merged: dict[tuple[int, ...], float] = {}
        for v, _, c in mine:
            merged[v] = merged.get(v, 0.0) + c
        if merged:
            _, _, post = reliabilities(sorted(merged.items()))
            out[kind] = classifier([(v, s, post[v], c) for v, s, c in mine])
    return out


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, row, kind, base, start, stop, value of every span that stays."""
    spans = written(votes(candidates(docs, id_col, text_col)), "spans")
    logit = F.when(F.lit(False), F.lit(0.0))
    for kind, w in fit(spans).items():
        f = [F.lit(1.0), *[(F.col(c) == 1).cast("double") for c in LABELERS], *[(F.col(c) == -1).cast("double") for c in LABELERS], *[F.getbit(F.col("shape"), F.lit(b)).cast("double") for b in range(3)]]
        logit = logit.when(F.col("kind") == kind, reduce(lambda a, b: a + b, [F.lit(x) * y for x, y in zip(w, f, strict=True)]))
    logit = F.coalesce(logit, F.lit(-1.0))
    base = spans.filter("base and ok").select("doc_id", "row", "kind", "base", "start", "stop", "value")
    wider = spans.filter(~F.col("base")).withColumn("p", 1 / (1 + F.exp(-logit))).filter(F.col("p") >= threshold)
    # a wider span gives way to any base span that it touches
    taken = base.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("taken"))
    wider = wider.join(taken, "row", "left").filter(~F.coalesce(F.exists("taken", lambda t: (t["start"] < F.col("stop")) & (F.col("start") < t["stop"])), F.lit(False)))
    return base.unionByName(wider.select("doc_id", "row", "kind", "base", "start", "stop", "value"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base counts by kind, base_sha256, spans, and the numbers of secrets and of all spans, for every row."""
    name = reduce(lambda a, k: a.when(F.col("kind") == k[0], k[1]), enumerate(ALL_KINDS), F.when(F.lit(False), ""))
    said = F.concat_ws(":", name, F.col("start").cast("string"), F.col("stop").cast("string"))
    item = F.struct("start", "kind", "stop", said.alias("said"))
    line = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["said"]), ",")
    by_doc = personal_spans(docs, id_col, text_col).groupBy("row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{n}") for k, n in enumerate(KINDS)],
        line(F.collect_list(F.when(F.col("base"), item))).alias("base_spans"), line(F.collect_list(item)).alias("spans"),
        F.count_if(F.col("kind") == ALL_KINDS.index("secret")).alias("n_secret"), F.count(F.lit(1)).alias("n_spans"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"))
    none = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c)
    return rows.join(by_doc, "row", "left").select(
        F.col("doc_id").alias(id_col), *[none(f"n_{k}", 0) for k in KINDS], F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), none("spans", ""), none("n_secret", 0), none("n_spans", 0))


def query(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
