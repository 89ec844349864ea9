"""Whitening, conversation repair and main texts: against brute force, and on odd inputs."""

import hashlib
import heapq
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from faithline.llm import conversations, main_text, whitening

VECTORS = "vec_id long, embedding array<float>, n string, component string, w string"


def fitted(vectors):
    """x, sums and covariance in exact fractions, for vectors of doubles."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(width)]
    cov = [[sum((Fraction(r[i]) - Fraction(sums[i], n)) * (Fraction(r[j]) - Fraction(sums[j], n)) for r in x) / n for j in range(width)] for i in range(width)]
    return x, sums, cov


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(60, 12)) @ np.diag(np.arange(1, 13)) + 3).astype(np.float32)
    rows = [(i, [float(c) for c in v], "x", "y", "z") for i, v in enumerate(vectors)]
    bad = [(100, None, "x", "y", "z"), (101, [1.0] * 11 + [None], "x", "y", "z"), (102, [float("nan")] * 12, "x", "y", "z"), (103, [float("inf")] + [0.0] * 11, "x", "y", "z")]
    got = whitening.whitened(spark.createDataFrame(rows + bad, VECTORS).repartition(7)).collect()
    x, sums, cov = fitted([r[1] for r in rows])
    n = len(x)
    values, basis = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    assert len(got) == n * 8 and {r.n for r in got} == {n} and {r.vec_id for r in got} == set(range(n))
    signs = {}
    for r in got:
        k, row = r.component, x[r.vec_id]
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))
        expected = float(np.dot([float(a - Fraction(s, n)) for a, s in zip(row, sums, strict=True)], basis[:, -k])) / math.sqrt(values[-k])
        sign = signs.setdefault(k, 1 if abs(expected - r.whitened) < abs(expected + r.whitened) else -1)
        assert r.whitened == pytest.approx(sign * expected, abs=1e-9)
        assert r.explained == pytest.approx(values[-k] / values.sum(), rel=1e-9) and r.identity_error < 1e-9


def test_exact_products_and_digits():
    rng = random.Random(1)
    for size in (1 << 10, 1 << 30, 1 << 52):
        y = [[rng.randint(-size, size) for _ in range(3)] for _ in range(50)]
        sums, cross = whitening.products(np.array(y, dtype=np.int64))
        assert sums == [sum(r[i] for r in y) for i in range(3)] and cross == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
    for v in (0, -1, 2**31 - 1, 2**31, -(2**31), -(2**31) - 1, 2**200 + 17, -(3**150)):
        assert sum(d << 32 * i for i, d in enumerate(whitening.digits(v))) == v
        assert all(abs(d) <= 2**32 for d in whitening.digits(v))


def test_whitening_of_odd_vectors(spark):
    def run(rows):
        return whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()

    extra = ("a", "b", "c")
    none = run([(1, None, *extra)])
    assert none == [] and whitening.whitened(spark.createDataFrame([], VECTORS)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = run([(1, [1.0, 2.0], *extra)])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    short = run([(1, [1.0], *extra), (2, [0.0, 0.0], *extra), (2, [0.0, 0.0], *extra), (None, [0.0, 1.0], *extra)])
    assert len(short) == 8 and {r.n for r in short} == {4} and {r.vec_id for r in short} == {1, 2, None} and all(r.identity_error < 1e-9 for r in short)
    flat = run([(i, [float(i), 5.0, 2.0 * i], *extra) for i in range(10)])  # one direction of variance
    assert sum(r.whitened is not None for r in flat) == 10 and {round(r.explained, 12) for r in flat if r.component == 1} == {1.0}
    huge = run([(1, [3e38, 0.0], *extra), (2, [-3e38, 1.0], *extra)])
    assert {r.deviation for r in huge} == {None} and all(abs(abs(r.whitened) - 1) < 1e-6 for r in huge if r.component == 1)


def test_scatter_does_not_depend_on_tasks(spark):
    rows = spark.createDataFrame([(i, [((i * 37) % 101) / 7.0, ((i * 53) % 89) / 3.0], "a", "b", "c") for i in range(5000)], VECTORS)
    one, many = (whitening.scatter(whitening.shifted(rows.repartition(k), "vec_id", "embedding", 1 << 40), 2) for k in (1, 9))
    assert one == many and one[0] == 5000


def repair(rows, by=conversations.Costs()):
    """(cost, audit, lines) of [(role, text)] by Dijkstra over (row, state) with the audit as the tie-break: no table, no backward pass."""
    faults, seen = [], set()
    for role, text in rows:
        last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
        faults.append("b" if not last else "d" if (role, text) in seen else "t" if last[1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}  # the state is the last role
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(lines), faults
        if (i, state) in done:
            continue
        done.add((i, state))
        turn = follow[state]
        name = {"u": "user", "a": "assistant"}[turn]
        heapq.heappush(queue, (cost + by.insert, audit + "I", i, turn, (*lines, f"{name}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + by.delete, audit + "D", i + 1, state, lines))
            if faults[i] in ("", "t"):
                more = by.truncated * (faults[i] == "t")
                if role[:1] == turn or (role[:1] == "s" and state == ""):
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                heapq.heappush(queue, (cost + by.rerole + more, audit + "R", i + 1, turn, (*lines, f"{name}:{text}")))


def expected(rows, costs):
    """The whole result by conversation, from (conv, turn, role, text) in Python."""
    by = {}
    for conv, turn, role, text in rows:
        mine = by.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            mine += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        cost, audit, lines, faults = repair([r[1:] for r in mine], costs)
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string, pos string, chunk string, k string"
EXTRA = ("x", "y", "z")


def check(spark, rows, by=conversations.Costs()):
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], CONV).repartition(5)
    got = conversations.repaired(conversations.damaged(df), conversations.own(df, conv=F.col("conv_id")), by=by).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows, by) and len(got) == len({r[0] for r in rows})
    return got


@pytest.mark.parametrize("by", [conversations.Costs(), conversations.Costs(delete=4, insert=1, rerole=3), conversations.Costs(2, 2, 2, 1)])
def test_conversation_repair_by_brute_force(spark, by):
    rng = random.Random(8)
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("assistant" if turn % 2 else "user") if turn or rng.random() < 0.7 else "system"
            role = rng.choice(["tool", "", None, "System", "umpire"]) if rng.random() < 0.05 else role
            rows.append((conv, turn + rng.randint(0, 1), role, rng.choice(["Yes.", "No!", "Why?", "cut", "  ", "", None, "end. \n", f"text {turn}."])))
    found = set("".join(r.audit for r in check(spark, rows, by)))
    assert found == set("DKR") if by.insert == 5 else "I" in found  # at a cost of 5, deleting is always cheaper


def test_conversations_over_many_chunks(spark):
    rng = random.Random(2)
    long_ = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice([f"t{t}.", "same.", "cut"])) for t in range(1500)]
    same = [(2, 7, "user", "again.")] * 700  # one turn, one text
    check(spark, [*long_, *same, *[(i, 0, "user", "q?") for i in range(3, 40)]])


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, None, None, None), (None, 3, "user", "a."), (5, None, "user", "late nulls first?"), (5, 2, "assistant", "b."), (6, 1, "user", "x" * 300_000 + "."), (6, 2, "assistant", "é😀!")]
    check(spark, rows)
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (got,) = check(spark, [(dropped, 0, "user", "gone.")])
    assert tuple(got)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    none = spark.createDataFrame([], CONV)
    assert conversations.repaired(conversations.damaged(none)).count() == 0
    assert conversations.repaired(conversations.damaged(spark.createDataFrame([(1, 1, "user", "q?", *EXTRA)], CONV))).count() == 1


PAGE = """<!doctype html><html><head><title>No title</title><meta name=x><style>p{}</style><body class="has-sidebar">
<header class=top><h2>Site name</h2></header><div class="cookieNotice"><p>We use cookies to make this site work for all of you.</p></div>
<nav><ul><li><a href="/">Home</a><li><a href="/b">Second page</a></ul></nav>
<form action=x><p>Search this site</p><input name=q></form><script>if (a < b) document.write("</p><p>scripted</p>")</script>
%s
<aside><p>See also these pages</p></aside><section id="comments"><h3>Comments</h3><article class="comment"><p>First! What a nice article this was to read.</p></article></section>
<div class="advert-box">Buy this thing now.</div><footer><p>&copy; Somebody, all rights reserved.</p></footer>"""
TEXT = "A title\nFirst paragraph & more, of some length.\nOh.\nIt has bold words and a link in it, broken in two.\na b\nThird one that is a bit longer than others.\nEnd."
BODY = """<h1>A title</h1><p>First   paragraph &amp; more,&#32;of some
length.<p>Oh.</p><!-- <p>not this</p> --><p>It has <b>bold</b> words and <a href='x>y'>a link</a> in it,<br/>broken in two.</p><div class="ad">Advert</div><table><tr><td>a</td><td>b</td></tr></table>
<p>Third one that is a bit longer than others.<aside>aside</aside></p><p>End.</p>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><article class='post'>%s</article></main>", "<div class='post-content'>%s</div>", "%s", "<section><div id=main-content>%s</section>", "<article><header>%s</header></article>"])
def test_main_text_of_layouts(wrap):
    assert main_text.extract(PAGE % (wrap % BODY)) == TEXT


def test_main_text_of_fragments():
    e = main_text.extract
    assert e(None) == e("") == e("<p> </p>") == e("<nav>menu</nav>") == e("<script>x") == ""
    assert e("plain < text &lt;b&gt; &amp;amp; &#x41;&eacute;") == "plain < text <b> &amp; Aé"
    assert e("<p>kept <!-- open comment <p>lost") == "kept" and e("<p>kept <a href=\"lost") == "kept"
    assert e("<article><p>cut of") == "cut of" and e("<P>A</P\n><P CLASS=x>B") == "A\nB"
    assert e("<div class=ad>only this</div>") == "only this"  # class names alone don't empty a page
    assert e("<nav><a>Home</a><article><p>The nav was never closed.</p></article>") == "The nav was never closed."
    assert e("<form><h1>T</h1><p>A page inside a form.</p></form>") == "T\nA page inside a form."
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(9)) + "</ul>"
    text = "".join(f"<p>Sentence {i} of a text with enough words.</p>" for i in range(9))
    assert e(f"<body>{menu}<div>{text}</div>{menu}<div>short</div>") == "\n".join(f"Sentence {i} of a text with enough words." for i in range(9))
    names = {"comments": True, "post-comments": True, "comment-body": False, "adBox": True, "shadow": False, "no-sidebar": False, "entry-content": False, "site-header": True, "download": False}
    assert {n: main_text.named_furniture(n) for n in names} == names


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "x" + "</p>" * 30_000, "<a " * 100_000, "<!-- " * 100_000, "<div a=b " + "a" * 300_000 + ">t", "<p>a" * 100_000, "<" * 200_000, '<a href="' * 50_000, "<div class='ad'>" * 30_000])
def test_main_text_of_long_pages_takes_linear_time(page):
    import time

    start = time.time()
    main_text.extract(page)
    assert time.time() - start < 10


def test_main_text_query_keeps_rows(spark):
    rows = [(1, "u", PAGE % BODY, "clash"), (1, "u", PAGE % BODY, "clash"), (None, None, None, "clash"), (2, "v", "", None), (3, "w", "<p>" + "é😀 " * 200_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in main_text.main_text(df).collect()}
    assert main_text.main_text(df).count() == 5 and got == {(1, "u", TEXT, len(TEXT)), (None, None, "", 0), (2, "v", "", 0), (3, "w", ("é😀 " * 200_000).strip(), 599_999)}
    assert main_text.main_text(df.limit(0)).count() == 0


def test_main_text_of_the_pages_is_their_article(spark):
    """The tables' pages have one layout: what a plain cut at its tags gives has to come out whole."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    given = {r.page_id: r.html for r in pages.collect()}
    for r in main_text.query(spark, "/root/testdata/sf0.01").collect():
        article = re.search("<article>(.*)</article>", given[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_short_pre_tokens_and_lasting_digests(monkeypatch):
    """Buckets over positions give what the queue of lists gives, also where a merge makes a pair of a lower rank; what a pre-token adds to the digests stays for the next task."""
    import random

    import public_tokenizers

    from faithline.llm import bpe

    draw = random.Random(3)
    for _ in range(40):
        tokens = [b"a", b"b", b"c", *{bytes(draw.choices(b"abc", k=draw.randint(2, 5))) for _ in range(40)}]
        order = draw.sample(range(len(tokens)), len(tokens))
        codec = bpe.Codec(dict(zip(tokens, order, strict=True)), public_tokenizers.PATTERN)
        for n in (1, 2, 7, bpe.SHORT, bpe.SHORT + 1):
            piece = bytes(draw.choices(b"abc", k=n))
            got = codec.merge(piece)
            with monkeypatch.context() as m:
                m.setattr(bpe, "SHORT", -1)
                assert got == codec.merge(piece) and codec.decode(got) == piece
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe._codec(*args).merge(" athinti".encode())
    assert bpe._lines(*args)[" athinti"] == ("".join(f" {i}" for i in ids).encode(), b" athinti")
    assert bpe._lines(*args) is bpe._lines(*args) and " athinti" in bpe._lines(*args)
