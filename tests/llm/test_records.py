"""WARC, chat windows, HTML, top-k search and the pipeline."""

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import bpe, chat, html, langid, queries, segments, warc
from panelwright.llm.base import Scratch
from tests.llm.test_dedup import brute
from tests.llm.test_text import code, slow_grams


@pytest.mark.parametrize("name", ["op1_warc_index", "op2_chat_windows", "op4_segment_topk", "op7_minhash_dedup", "op9_multi_index_dedup"])
def test_queries_match_sql(spark, sf, duck, rows_of, name):
    assert rows_of(queries.queries()[name](spark, sf)) == rows_of(duck.sql(queries.oracle_sql()[name]).df())


# ---------------------------------------------------------------- WARC


def pages(spark):
    rows = [(5, "http://www.Example.com/b?q=1", "<p>x</p>", 1), (3, "http://example.com:80/a b", "<p>x</p>", 1), (9, None, None, 1), (2, "", "", 1), (7, "http://[bad", "é\r\n\r\nWARC/1.1", 1), (8, "http://example.com/a b", "y" * 100000, 1), (-4, "http://a.b/\n\t", "z", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload long")


def test_warc_round_trip(spark):
    out = {r.capture_id: r for r in warc.archive_and_read(pages(spark)).collect()}
    rows = {r.page_id: r for r in pages(spark).collect()}
    assert set(out) == set(rows)
    for i, r in out.items():
        body = (rows[i].html or "").encode()
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = min(j for j, x in rows.items() if (x.html or "") == (rows[i].html or ""))
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert r.payload is None if first != i else bytes(r.payload) == body
    assert warc.archive_and_read(pages(spark).limit(0)).collect() == []


def test_every_row_has_a_record(spark):
    """Null and repeated ids, also with other contents under the same id and url, and a null id's payload of its own."""
    rows = [(5, "http://a.b/", "x"), (5, "http://a.b/", "y"), (5, "http://a.b/", "x"), (3, "http://a.b/", "y"), (None, "http://a.b/", "x"), (None, None, "only"), (None, None, "only"), (None, None, None), (9, "http://a.b/", "z")]
    got = warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    seen = sorted((r.capture_id or 0, r.url, r.record_type, r.refers_to or 0, bytes(r.payload or b"").decode(), r.payload_bytes) for r in got)
    u = "http://a.b/"
    assert seen == sorted([(5, u, "response", 0, "x", 1)] * 2 + [(5, u, "revisit", 3, "", 1), (3, u, "response", 0, "y", 1), (0, u, "revisit", 5, "", 1), (0, "", "response", 0, "only", 4), (0, "", "response", 0, "only", 4), (0, "", "response", 0, "", 0), (9, u, "response", 0, "z", 1)])


def test_archives_are_valid_members(spark, tmp_path):
    captures = warc.write_archives(Scratch(spark), pages(spark), f"file://{tmp_path}").collect()
    for c in captures:
        with open(tmp_path / c.file, "rb") as f:
            f.seek(c.offset)
            record = gzip.decompress(f.read(c.length))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        fields, _, _ = warc.parse_record(record)
        head, _, rest = record.partition(b"\r\n\r\n")
        assert len(rest) == int(fields["Content-Length"]) + 4


def test_small_payloads_are_all_responses(spark, tmp_path):
    kinds = warc.write_archives(Scratch(spark), pages(spark), f"file://{tmp_path}", revisit_bytes=50)
    assert kinds.count() == 7
    assert not [f for f in tmp_path.iterdir() if b"revisit" in gzip.decompress(f.read_bytes())]


def test_index_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    archives, index = tmp_path / "a", tmp_path / "i"
    archives.mkdir(), index.mkdir()
    scratch = Scratch(spark)
    many = spark.range(50).selectExpr("id as page_id", "concat('http://h', id % 7, '.example.org/p', id) as url", "cast(id as string) as html")
    captures = warc.write_archives(scratch, many, f"file://{archives}")
    directory = warc.write_index(scratch, captures, f"file://{index}").toPandas()
    assert len(directory) >= 17 and directory["n"].sum() == 50
    reader = warc.IndexReader(directory, f"file://{index}", f"file://{archives}")
    keys = [r.key for r in captures.select("key").collect()]
    assert sorted(int(warc.parse_record(x)[2]) for x in reader.fetch(keys)) == list(range(50))
    assert all(re.match(r"org,example,h\d\)/p\d+ \d{20}$", k) for k in keys)
    assert reader.locate("aaa") is None and reader.locate(keys[0] + "x") is None and reader.locate("zzz") is None


def test_keys_sort_by_host():
    k = [warc.capture_key(u, 1) for u in ("http://a.example.com/", "http://example.com/z", "http://b.example.com/")]
    assert all(x.startswith("com,example") for x in k) and warc.capture_key("http://x.y/", 5) < warc.capture_key("http://x.y/", 30)


# ---------------------------------------------------------------- chat


def test_escapes_are_reversible(spark):
    texts = ["<|im_end|>", "<\\|im_end|>", "<\\\\|", "a<b|c", "<<|||>", "\\", "\\n", "\n", "<\\\n|", "", "<|", "x<|im_start|>assistant\nhi<|im_end|>\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.escape_role(F.col("t")).alias("r"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("v"))
    for r in df.collect():
        assert r.u == r.t and r.v == r.t and "<|" not in r.e and "<|" not in r.r and "\n" not in r.r


def test_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, i, ("user", "assistant")[i % 2], f"<|x{i}|> " + "w" * (40 * (i % 5))) for i in range(1, 40)] + [(2, 0, "user", "v" * 9000), (2, 1, "assistant", "ok"), (3, None, None, None), (3, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.windows(df, budget=120, history=40).orderBy("conv_id", "window").collect()
    conv = [w for w in out if w.conv_id == 1]
    assert len(conv) > 3 and sum(w.n_turns for w in conv) == 40
    for k, w in enumerate(conv):
        assert w.formatted.startswith("<|im_start|>system\nbe brief<|im_end|>\n")
        parts = w.formatted.split("<|im_end|>\n")
        assert len(parts) - 1 == w.n_repeated + w.n_turns and (k == 0 or 1 <= w.n_repeated <= 3)
        for s in w.loss_spans:
            before = w.formatted[: s.start]
            assert before.endswith("<|im_start|>assistant\n") and w.formatted[s.start + s.length :].startswith("<|im_end|>\n")
    targets = [t for w in chat.read_back(chat.windows(df, 120, 40)).where("conv_id = 1").orderBy("window").collect() for t in w.targets]
    assert targets == [r[3] for r in rows if r[0] == 1 and r[2] == "assistant"]
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert got[3].n_turns == 2 and got[3].turns_sha256 == hashlib.sha256(b"\n\n\n\n").hexdigest() and got[3].loss_chars == 0
    assert got[2].loss_sha256 == hashlib.sha256(b"ok").hexdigest()
    assert chat.digests(df.limit(0)).collect() == []


def test_windows_keep_within_the_budget(spark):
    """Tokens of each whole window, the system turn and history included; only a lone turn can exceed it."""
    r = np.random.default_rng(3)
    rows, sizes = [], {}
    for conv, system in enumerate([None, 40, 300, 1600, 1700, 4000]):
        n = 30
        if system is not None:
            rows.append((conv, 0, "system", "s" * system))
        rows += [(conv, i + 1, ("user", "assistant")[i % 2], "t" * int(r.choice([0, 30, 200, 700, 1500, 2500]))) for i in range(n)]
        sizes[conv] = n + (system is not None)
    count = lambda part: -(-len(part.split("\n", 1)[1]) // 4) + 4
    out = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    over = 0
    for w in out:
        parts = [count(p) for p in w.formatted.split("<|im_end|>\n")[:-1]]
        system = count(w.formatted.split("<|im_end|>\n")[0]) if w.formatted.startswith("<|im_start|>system") else 0
        fresh = parts[w.n_repeated :]
        if system and w.n_repeated == 0:
            fresh = fresh[1:]
        assert sum(parts) <= chat.BUDGET or len(fresh) == 1 and sum(parts) == system + fresh[0]
        over += sum(parts) > chat.BUDGET
        assert sum(parts) - system - sum(fresh) <= chat.HISTORY and w.n_repeated <= 1 + chat.HISTORY_TURNS
    assert over and {c: sum(w.n_turns for w in out if w.conv_id == c) for c in sizes} == sizes
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append(f"{role}\n{text}\n")
    assert {x.conv_id: x.turns_sha256 for x in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()} == {c: hashlib.sha256("".join(t).encode()).hexdigest() for c, t in want.items()}


def test_chat_runs_no_python(spark, sf):
    plan = queries.op2_chat_windows(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("a&amp;b &lt;c", "a&b <c"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("<ul><li>x<li>y<ol><li>i<li>ii</ol></ul>", "- x\n- y\n  1. i\n  2. ii"),
        ("<ol start=9><li>x<li value=20>y<li>z</ol>", "9. x\n20. y\n21. z"),
        ("<table><tr><th>a<th>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"),
        ("<table><tr><td>1<br>2<td>x<tr><td colspan=2>wide</table>", "1 | x\n2 |\nwide"),
        ("<title>t</title><style>s</style><script>if(a<b)'</p>'</script>v<!-- c -->w", "vw"),
        ("<p hidden>a<p style='color:red; display : none'>b<p>c", "c"),
        ("<b>bold <i>both</b> still</i> end", "bold both still end"),
        ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<dl><dt>T<dd>D</dl>", "T\n  D"),
        ("<details><summary>s</summary>gone</details><details open><summary>t</summary>shown</details>", "s\n\nt\nshown"),
        ("<p>x</p></div></table>y<", "x\n\ny<"),
        ("<a href='x>y'>z</a>", "z"),
        ("<textarea><b>raw</b></textarea>", "<b>raw</b>"),
        ("<html><head><meta charset=utf-8></head><body>q</body></html>r", "q r".replace(" ", "")),
    ],
)
def test_rendering(page, text):
    assert html.text_of(page) == text


@pytest.mark.parametrize(
    ("style", "shown"),
    [
        ("backface-visibility: hidden", True),
        ("-webkit-backface-visibility:hidden;backface-visibility:hidden", True),
        ("--display:none; x-display: none", True),
        ("/* display:none; */ color:red", True),
        ("background:url(a;display:none)", True),
        ("content:'; visibility:hidden'", True),
        ("display:none-such", True),
        ("backface-visibility:hidden;visibility:hidden", False),
        ("/* off */ DISPLAY : none !important", False),
        ("color:red;\n display:/**/none;", False),
        ("content:\"it's\";visibility:collapse", False),
        ("font-family:it's;display:none", False),
    ],
)
def test_hiding_styles(style, shown):
    assert html.text_of(f"<p>a<div style=\"{style.replace(chr(34), '&quot;')}\">b</div>") == ("a\n\nb" if shown else "a")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div>" * 210 + "<p style='display:none'>secret</p>shown", "shown"),
        ("<p class=a\">text one</p><p>he said \"hi\" there</p>", "text one\n\nhe said \"hi\" there"),
        ("<p style='visibility:hidden'>a <b style='visibility:visible'>b</b> c", "b"),
        ("<p hidden style='display:block'>a</p><p style='display:none!important;display:block'>b", "a"),
        ("<map>t<area alt=x></map><input type=submit value=Go><input type=hidden value=no><input type=password value=no>", "tGo"),
        ("<table><tr><td rowspan=2>R<td>a<tr><td>b<tr><td>c<td>d</table>", "R | a\n  | b\nc | d"),
        ("<table><tr><td>a<td rowspan=0>x<tr><td>b<tr><td>c<td>d</table>", "a | x\nb\nc |   | d"),
        ("<table><tr><td colspan=1000>wide one<tr><td>a<td>b</table>", "wide one\na | b"),
        ("<table><tfoot><tr><td>f</tfoot><tr><td>b<thead><tr><td>h</table>", "h\nb\nf"),
        ("<table><tr><td style='display:none'>x<td>a<tr style='visibility:collapse'><td>y<tr><td style='visibility:hidden'>zz<td>b</table>", "a\n  | b"),
        ("<ol reversed><li>x<li>y</ol>", "2. x\n1. y"),
        ("<ol type=A start=26><li>x<li>y</ol><ol type=i><li value=4>z</ol>", "Z. x\nAA. y\n\niv. z"),
        ("a<!-->b<!-- x --!>c<!x>d<?y>e</>f</ x>g", "abcdefg"),
        ("x < y <3 a<b c='", "x < y <3 a"),
        ("a<svg><path/><title>t</title><text>b</text></svg>c", "abc"),
        ("<ul><li style='display:none'>x<li style='visibility:hidden'>y<li>z</ul>", "- z"),
    ],
)
def test_rendering_of_odd_pages(page, text):
    assert html.text_of(page) == text


def test_html_matches_a_slow_renderer(monkeypatch):
    """Random trees, written out as HTML, against a recursive renderer of the trees themselves."""
    r = np.random.default_rng(12)
    words = iter(range(10**9))
    hiding = [("", True, None)] * 12 + [(" hidden", False, None), (" style='display:none'", False, None), (" style='visibility: hidden'", True, False), (" style='color:red; visibility:visible'", True, True)]

    def tree(depth, inline=False):
        if depth and inline:
            depth = 1 if r.random() < 0.5 else 0
            return ("span", hiding[r.integers(len(hiding))], [tree(0)]) if depth else tree(0)
        kind = r.choice(["text", "span", "div", "p", "ul", "ol", "blockquote", "table"], p=[0.4, 0.12, 0.12, 0.08, 0.08, 0.06, 0.04, 0.1]) if depth else "text"
        if kind == "text":
            return ("text", [f"w{next(words)}" for _ in range(r.integers(1, 4))])
        few = lambda: [tree(depth - 1, kind == "p") for _ in range(r.integers(0, 4))]
        style = hiding[r.integers(len(hiding))]
        if kind in ("ul", "ol"):
            return (kind, style, [(hiding[r.integers(len(hiding))], few()) for _ in range(r.integers(1, 4))])
        if kind == "table":
            rows, wide = int(r.integers(1, 4)), int(r.integers(1, 4))
            taken, cells = set(), [[] for _ in range(rows)]
            for y in range(rows):
                for x in range(wide):
                    if (y, x) not in taken:
                        across, deep = int(r.integers(1, wide - x + 1)), int(r.integers(1, rows - y + 1))
                        if any((y, x + i) in taken for i in range(across)):
                            across = 1
                        taken |= {(y + j, x + i) for j in range(deep) for i in range(across)}
                        cells[y].append((x, across, deep, few()))
            return (kind, style, cells)
        return (kind, style, few())

    def write(n):
        if n[0] == "text":
            return " " + " ".join(n[1]) + " "
        inside = lambda xs: "".join(map(write, xs))
        if n[0] in ("ul", "ol"):
            body = "".join(f"<li{s[0]}>{inside(xs)}</li>" for s, xs in n[2])
        elif n[0] == "table":
            body = "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{inside(xs)}</td>" for _, a, d, xs in row) + "</tr>" for row in n[2])
        else:
            body = inside(n[2])
        return f"<{n[0]}{n[1][0]}>{body}</{n[0]}>"

    def boxes(n, seen, deep):
        """Words, and (margin before, lines, margin after) for blocks."""
        if n[0] == "text":
            return list(n[1]) if seen else []
        _, shown, own = n[1]
        if not shown:
            return []
        seen = seen if own is None else own
        inside = lambda xs, d=deep, s=seen: stack([b for x in xs for b in boxes(x, s, d)])
        margin = {"div": 0, "p": 1, "blockquote": 1, "table": 1, "ul": 0 if deep else 1, "ol": 0 if deep else 1}.get(n[0])
        if n[0] == "span":
            return [b for x in n[2] for b in boxes(x, seen, deep)]
        if n[0] in ("ul", "ol"):
            out, k = [], 0
            for (_, li_shown, li_own), xs in n[2]:
                if li_shown:
                    k += 1
                    s = seen if li_own is None else li_own
                    a, lines, b = inside(xs, deep + 1, s)
                    mark = f"{k}. " if n[0] == "ol" else "- "
                    first = mark if s else " " * len(mark)
                    out.append((a, [((first if i == 0 else " " * len(mark)) + x).rstrip() if x else x for i, x in enumerate(lines)], b))
            return [(margin, [], margin), stack(out), (margin, [], margin)]
        if n[0] == "blockquote":
            a, lines, b = inside(n[2], deep + 1)
            return [(margin, [], 0), (a, [("  " + x).rstrip() for x in lines], b), (margin, [], 0)]
        if n[0] == "table":
            rows = [[(x, a, inside(xs, 0)[1]) for x, a, _, xs in row] for row in n[2]]
            rows = [row for row in rows if any(lines for *_, lines in row)]
            size = 1 + max((x for row in rows for x, *_ in row), default=0)
            wide = [max([len(t) for row in rows for x, a, lines in row if x == c and min(a, size - x) == 1 for t in lines], default=0) for c in range(size)]
            out = []
            for row in rows:
                for y in range(max(len(lines) for *_, lines in row)):
                    if sum(wide) + 3 * (size - 1) > html.ALIGNED:
                        out.append(" | ".join(lines[y] for *_, lines in row if y < len(lines) and lines[y]))
                        continue
                    slots = {c: " " * wide[c] for c in range(size)}
                    for x, a, lines in row:
                        upto = min(x + a, size)
                        slots[x] = (lines[y] if y < len(lines) else "").ljust(sum(wide[x:upto]) + 3 * (upto - x - 1))
                        for c in range(x + 1, upto):
                            del slots[c]
                    last = max(x + min(a, size - x) for x, a, _ in row)
                    out.append(" | ".join(t for c, t in slots.items() if c < last).rstrip())
            return [(margin, out, margin)]
        a, lines, b = inside(n[2])
        return [(max(a, margin), lines, max(b, margin))]

    def stack(items):
        before, lines, gap, line = 0, [], 0, []
        for b in [*items, (0, [], 0)]:
            if isinstance(b, str):
                line.append(b)
                continue
            for a, more, c in [*([(0, [" ".join(line)], 0)] if line else []), b]:
                gap = max(gap, a)
                if more:
                    if not lines:
                        before = gap
                    lines = lines + [""] * (gap if lines else 0) + more
                    gap = 0
                gap = max(gap, c)
            line = []
        return (before, lines, gap) if lines else (gap, [], gap)

    for k in range(400):
        monkeypatch.setattr(html, "ALIGNED", 240 if k % 2 else 20)  # where tables are too wide to align
        nodes = [tree(4) for _ in range(4)]
        page = "".join(map(write, nodes))
        want = stack([b for n in nodes for b in boxes(n, True, 0)])[1]
        assert html.text_of(page) == "\n".join(want), page


def test_html_survives_anything():
    r = np.random.default_rng(1)
    bits = ["<", ">", "</", "p", "table", "td", " ", "x", "<tr>", "<li>", "<!--", "-->", "&", "'", '"', "<pre>", "</table>", "<select>", "\n"]
    for _ in range(300):
        html.text_of("".join(r.choice(bits, 60)))
    assert html.text_of("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html.text_of("<ul><li>x" * 3000).count("x") == 3000 and html.text_of("<table><tr><td>a<td>" * 300).count("a") == 300
    assert html.text_of("<p>" + "word " * 50000).count("word") == 50000


def test_html_loses_no_text(spark, sf):
    for r in pq.read_table(f"{sf}/pages.parquet").to_pylist():
        body = re.sub(r"<script.*?</script>|<style.*?</style>|<title.*?</title>|<!--.*?-->", "", r["html"], flags=re.S)
        import html as std

        want = std.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        got = [w for w in html.text_of(r["html"]).split() if w != "-"]
        assert got == [w for w in want if w != "-"]
    df = spark.createDataFrame([(1, None, "n"), (2, "<p>a", "n")], "page_id long, html string, text string")
    assert [x.text for x in html.extract(df).collect()] == [None, "a"]
    kept = html.extract(df.withColumnRenamed("text", "html2"), keep=("page_id", "html2", "html"))
    assert kept.columns == ["page_id", "html2", "html", "text"] and html.extract(df, keep=("text", "page_id")).columns == ["page_id", "text"]
    assert kept.collect()[1][:] == (2, "n", "<p>a", "a")


# ---------------------------------------------------------------- top-k


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(segments, "SHARD", 90)
    monkeypatch.setattr(segments, "QUERIES", 7)
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(400, 24)) * np.linspace(3, 0.1, 24), 1)
    x[200:230] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(1000, None), (1020, [float("nan")] * 24), (1040, [None] * 24), (1060, []), (1080, [1.0]), (1100, [1e12] * 24), (1120, [1.0])]
    got = segments.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    q = np.floor(64 * x).astype(int)
    want = []
    for i in range(0, 400, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:20]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    want += [(1080, 1, 1120, 64 * 64), (1120, 1, 1080, 64 * 64)]
    # a vector of large components takes part like any other: 1e12 * 64 is exact, and so are its sums
    wide = [64 * 10**12] * 24
    for i in range(0, 400, 20):
        s = sum(int(a) * b for a, b in zip(q[i], wide))
        mine = [(-w[3], w[2]) for w in want if w[0] == i] + [(-s, 1100)]
        want = [w for w in want if w[0] != i] + [(i, k + 1, j, -t) for k, (t, j) in enumerate(sorted(mine)[:20])]
    scores = sorted((-sum(int(a) * b for a, b in zip(q[j], wide)), j) for j in range(400))[:20]
    want += [(1100, k + 1, j, -t) for k, (t, j) in enumerate(scores)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert segments.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).collect() == []


def test_top_k_counts_repeated_rows_once(spark):
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(60, 8)), 1)
    x[7] *= 3
    x[9, :4], x[9, 4:] = x[8, 4:], x[8, :4]
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)]
    rows += [rows[7]] * 15 + [(7, [-v for v in rows[7][1]])] * 10 + [(8, rows[9][1])] * 5  # also other vectors of an id
    got = segments.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True))
    q = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    want = []
    for i in range(60):
        best = sorted({(-int(a @ b), j) for k, a in q if k == i for j, b in q if j != i})[:20]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_shards_profit_from_the_first_ones_thresholds():
    """Of isotropic vectors, four shards with the first one's thresholds score hardly more than one stream, less than on their own."""
    r = np.random.default_rng(4)
    x = np.floor(64 * r.standard_normal((16_384, 64)) / 8)
    ids, q = np.arange(len(x)), np.arange(64)
    one = segments.TopK(ids[q], x[q], 20)
    for at in range(0, len(x), 4096):
        one.offer(ids[at : at + 4096], x[at : at + 4096])
    parts, floors = [], None
    for shard in range(4):
        t = segments.TopK(ids[q], x[q], 20, floors)
        t.offer(ids[shard::4], x[shard::4])
        parts.append(t)
        if floors is None:
            floors = {k: int(np.sort(t.top[t.top[:, 0] == k, 1])[-20]) for k in range(len(q))}
    share = lambda ts: sum(t.scored for t in ts) / sum(t.pairs for t in ts)
    assert share(parts) <= 1.05 * share([one])
    alone = [segments.TopK(ids[q], x[q], 20) for _ in range(4)]
    for shard, t in enumerate(alone):
        t.offer(ids[shard::4], x[shard::4])
    assert share(parts) < 0.95 * share(alone), (share(parts), share(alone))
    found = np.concatenate([t.top for t in parts])
    for k in range(len(q)):
        mine = found[found[:, 0] == k]
        mine = mine[np.lexsort((mine[:, 2], -mine[:, 1]))][:20]
        assert mine.tolist() == one.top[one.top[:, 0] == k].tolist()


def test_top_k_agrees_with_its_sql_on_repeated_rows(spark):
    import duckdb

    r = np.random.default_rng(12)
    rows = [(int(i), r.integers(-3, 4, 4).astype(float).tolist(), "ask" if i % 20 == 0 else None) for i in r.integers(0, 60, 200)]
    rows += rows[:50]
    con = duckdb.connect()
    con.sql("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", [(i, [x / 64 for x in v]) for i, v, _ in rows])
    want = sorted(map(tuple, con.sql(segments.oracle()).fetchall()))
    df = spark.createDataFrame([(i, [x / 64 for x in v], t) for i, v, t in rows], "vec_id long, embedding array<double>, kind string")
    names = ["query_id", "rank", "vec_id", "score"]
    got = sorted(tuple(x[c] for c in names) for x in segments.top_k(df, F.col("kind") == "ask").collect())  # a condition on another column
    assert got == [tuple(w) for w in want] and len(got) > 40


def test_top_k_of_large_components():
    """Scores within and beyond longs and doubles, in blocks whose other pairs are small."""
    r = np.random.default_rng(4)
    x = np.floor(r.normal(size=(300, 6)) * 10.0 ** r.integers(0, 13, (300, 1)))
    x[:4] *= 10.0 ** np.array([[20], [60], [140], [15]])
    ids = np.arange(300)
    for part in (slice(0, 300), slice(0, 20), slice(20, 300)):
        top = segments.TopK(ids[part], x[part], 7)
        for at in range(0, 300, 90):
            top.offer(ids[at : at + 90], x[at : at + 90])
        got = {}
        for f in top.results():
            for q, c, s, e in f.itertuples(index=False):
                got.setdefault(q, []).append((s, e or b"", -c))
        rows = [[int(v) for v in row] for row in x]
        for q in ids[part].tolist():
            best = sorted((-sum(a * b for a, b in zip(rows[q], rows[c])), c) for c in range(300) if c != q)[:7]
            mine = sorted(got[q], reverse=True)[:7]
            assert [-c for *_, c in mine] == [c for _, c in best]
            assert [s for s, *_ in mine] == [min(max(-s, -(1 << 63)), (1 << 63) - 1) for s, _ in best]
    xs = [0, 1, -1, 255, 256, -256, 1 << 63, -(1 << 63), (1 << 200) + 1, 1 << 200, -(1 << 200)]
    assert sorted(xs) == sorted(xs, key=segments.sortable)


def test_bounds_spare_scores():
    """Where vectors have structure, few pairs are scored; the result is that of brute force."""
    r = np.random.default_rng(7)
    x = np.floor(64 * np.cumsum(r.normal(size=(4000, 64)), axis=1) * r.choice([0.1, 1, 3], (4000, 1)))
    top = segments.TopK(np.arange(100), x[:100], 20)
    for at in range(0, 4000, 1000):
        top.offer(np.arange(at, at + 1000), x[at : at + 1000])
    assert top.scored < 0.1 * top.pairs
    full = x[:100] @ x.T
    for q in range(100):
        best = sorted((-s, c) for c, s in enumerate(full[q]) if c != q)[:20]
        assert [(-s, c) for s, c in top.top[top.top[:, 0] == q][:, 1:].tolist()] == best


def test_bounds_hold():
    r = np.random.default_rng(5)
    a, b = r.normal(size=(50, 30)), r.normal(size=(60, 30))
    exact, last = a @ b.T, None
    for n in segments.LEVELS:
        bound = segments.segment_features(a, n) @ segments.segment_features(b, n).T
        assert (bound >= exact - 1e-9).all()
        assert last is None or bound.sum() <= last + 1e-6
        last = bound.sum()


# ---------------------------------------------------------------- pipeline


def test_pipeline_matches_its_stages_by_brute_force(spark, sf):
    """Language by slow profiles, near duplicates by all pairs, copies by a Poisson inversion of its own, ids by the tokenizers library."""
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    size = langid.PROFILE
    train = {}
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 5 and d["lang"] is not None:
            train.setdefault(d["lang"], Counter()).update(slow_grams(d["text"] or ""))
    rank = lambda counts: sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]
    known = {g for counts in train.values() for g in rank(counts)}
    left = [d for d in docs if known.intersection(rank(slow_grams(d["text"] or "")))]
    assert len(left) == len(docs)  # clean documents stay
    comp = brute([(d["doc_id"], d["text"]) for d in left])
    left = [d for d in left if comp[d["doc_id"]][1] == d["doc_id"]]
    sizes = Counter(d["source"] for d in left)
    weights = sum(math.sqrt(n) for n in sizes.values())
    u = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2.0**52
    library = bpe.codec(queries.VOCABULARY).library
    want = []
    for d in left:
        mean = math.sqrt(sizes[d["source"]]) / weights * len(left) / sizes[d["source"]]
        draw, at, below = u(f"17:copies:{d['doc_id']}"), 0, math.exp(-mean)
        while below <= draw:
            at += 1
            below += math.exp(at * math.log(mean) - mean - math.lgamma(at + 1))
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        want += [(d["doc_id"], d["lang"] or "", d["source"] or "", len(ids), ids)] * at
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.lang or "", r.source or "", r.n_tokens, r.ids) for r in out) == sorted(want) and len(out) > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "mix", "tokenise"]


def test_pipeline_keeps_short_texts_of_a_large_script(spark):
    r = np.random.default_rng(2)
    p = 1 / np.arange(1, 3501)
    write = lambda n: "".join(chr(0x4E00 + k) for k in r.choice(3500, n, p=p / p.sum()))
    rows = [(i, "\u3002".join(write(9) for _ in range(40)), "zh") for i in range(150)] + [(i, "the cat sat on the mat and the dog lay by it", "en") for i in range(150, 170)]
    short = [write(int(n)) for n in r.integers(1, 60, 300)] + ["OK", "xyz", chr(0x4E00 + 3499)]
    rows += [(1000 + i, t, None) for i, t in enumerate(short)] + [(2000, "\u043f\u0440\u0438\u0432\u0435\u0442, \u043c\u0438\u0440", None), (2001, "12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'a' as source", "cast(length(text) as long) as n_chars")
    left = {x.doc_id for x in corpus_pipeline.language(spark, docs, "").collect()}
    assert left == {x[0] for x in rows} - {2000, 2001}


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    a, b = "the cat sat on the mat and slept", "another text that is about dogs only"
    rows = [(1, a, "en", "s", 1)] * 3 + [(1, a, "en", "r", 1), (2, a, "en", "s", 1)] + [(None, b, "en", "s", 1)] * 2 + [(None, "third", None, None, None)] + [(3, "one more", "en", "s", 1)]
    docs = Scratch(spark).save(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert tuple(out.columns) == corpus_pipeline.COLUMNS
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([rows[3], rows[5], rows[7], rows[8]], key=repr)


def test_pipeline_stages_keep_columns_and_take_edge_cases(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12", "en", "a", 2), (4, "the cat sat on the mat", "en", "a", 22), (5, "The cat sat on the mat", None, None, 22), (None, "the dog", "en", "a", 7), (7, "日本語の文章です", None, "a", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("label", F.lit(1))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = Scratch(spark).save(stage(spark, docs, ""), name)
        if k < 3:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        if name == "near_dedup":
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 4]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []


def test_layout_of_tables_is_bounded():
    """No text grows with rows times the widest cell, columns or lines of another cell."""
    long = "word " * 10_000
    pages = {
        "wide cell": "<table>" + "<tr><td>a<td>b<td>c" * 2000 + f"<tr><td>{long}<td>x<td>y</table>",
        "many columns": "<table><tr>" + "<td>wide cell here" * 400 + "<tr><td>x<td colspan=390><td>y" * 2000 + "</table>",
        "many lines": "<table><tr>" + "<td>c" * 500 + "<td>" + "l<br>" * 5000 + "</table>",
        "spans": "<table><tr><td colspan=1000>a<td>b" + "<tr><td colspan=999><td>x<td>y" * 2000 + "</table>",
        "nested": "<table><tr><td>" * 40 + long + "<tr><td>z" * 500,
    }
    for name, page in pages.items():
        text = html.text_of(page)
        assert len(text) <= 12 * len(page), (name, len(page), len(text))
    assert html.text_of(pages["wide cell"]).split("\n")[:2] == ["a | b | c", "a | b | c"]
    assert html.text_of(pages["wide cell"]).count("word") == 10_000 and html.text_of(pages["many lines"]).count("l") == 5000
    edge = "x" * (html.ALIGNED - 4)
    assert html.text_of(f"<table><tr><td>a<td>b<tr><td>{edge}<td>c</table>").split("\n")[0] == "a" + " " * (len(edge) - 1) + " | b"
    assert html.text_of(f"<table><tr><td>a<td>b<tr><td>{edge}x<td>c</table>").split("\n")[0] == "a | b"
