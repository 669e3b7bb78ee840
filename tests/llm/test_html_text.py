import html
import random
import re
import time

import numpy as np

from quillspark.llm import html_text as H
from quillspark.llm import queries


def got(df, **how):
    rows = H.main_texts(df, **how).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    return sorted(((r["page_id"], r["text"]) for r in rows), key=repr)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_tables_against_a_plain_cut(spark, sf):
    """The pages of the tables have one article without further parts: its text is what stands between its tags."""
    for folder in (sf, "/root/testdata/sf0.01"):
        table = spark.read.parquet(f"{folder}/pages.parquet")
        want = []
        for r in table.collect():
            inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
            blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
            want.append((r["page_id"], "\n\n".join(x for x in blocks if x)))
        rows = [(r["page_id"], r["text"]) for r in queries.op13_html_text(spark, folder).collect()]
        assert sorted(rows) == sorted(want)


def text(source):
    return "\n\n".join(t for sure, t in H.page_blocks(source) if sure)


def test_what_is_no_article_goes():
    source = """<!doctype html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav>menu</nav><div id="cookieNotice">We use</div>
    <main><p>before</p><article class="post comments-open"><header><h1>Head &amp; line</h1><span>by x</span></header><p>One  <b>two\n</b>thr<i>ee</i><br>four.</p>
    <div class="ad-slot">Buy</div><aside>more</aside><p class="notice">Note</p><form><p>Ask<input></form><script>if (a < b) "</article>"</script><style>p{}</style>
    <ul><li>a<li>b &#x41;&copy;</ul><table><tr><td>c<td>d</table>loose<p hidden>h</p><p style="display: none">h</p><!-- <p>no</p> --><p>last<article class="comment">c1</article>
    <section class="reader-comments"><p>c2</p></section><footer>f</footer></article><p>after</p></main><div class="footer">g</div></body>"""
    assert text(source).split("\n\n") == ["Head & line", "One two three four.", "a", "b A©", "c", "d", "loose", "last"]


def test_broken_markup():
    assert text("<article><h1>a</h1><p><b>b<br><p>c</p></article><footer>f") == "a\n\nb\n\nc"
    assert text("<main><p>a<div>b</p>c") == "a\n\nb\n\nc"
    assert text("<article><p>a</b></i></section> b</article>") == "a b"
    assert text("<article><b><p>x</b>y</p></article>") == "xy"
    assert text("<article>a<p>b</article>c") == "a\n\nb"
    assert text("<article>a &am; &amp b &quo < c <3 d</article>") == "a &am; & b &quo < c <3 d"
    assert text("<article>a<!-- b") == "a" and text("<article>a<script>b") == "a" and text("<article>a<p class='x") == "a"
    assert text("<article><span class=ad>x</span>y<p title='>'>z") == "y\n\nz"
    assert H.page_blocks("") == [] and H.page_blocks("<nav>x</nav>") == [] and H.page_blocks("just text") == [(False, "just text")]


def test_long_pages_take_linear_time():
    for part in ("<p>a", "<b>", "</b>", "<a ", "<!--", "<div><i>", "<b><p></b>", "&amp", "<li>", "<", "</p", "<article>x", "a=\"", "<h1>"):
        took = []
        for n in (20_000, 80_000):
            start = time.perf_counter()
            H.page_blocks("<article>" + part * n)
            took.append(time.perf_counter() - start)
        assert took[1] < 12 * took[0] + 0.3, part


def plain_cover(streams, run):
    """Which tokens lie in a run of ``run`` tokens that stands in two different streams, by looking at all of them."""
    lists = [s.split() for s in streams]
    on = {}
    for k, p in enumerate(lists):
        for i in range(len(p) - run + 1):
            on.setdefault(tuple(p[i : i + run]), set()).add(k)
    out = []
    for p in lists:
        c = np.zeros(len(p), bool)
        for i in range(len(p) - run + 1):
            if len(on[tuple(p[i : i + run])]) > 1:
                c[i : i + run] = True
        out.append(c)
    return out


def test_suffix_ranks_against_all_windows():
    rng = random.Random(1)
    for _ in range(30):
        streams = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(6)]
        lists, rank, begins, names, on = H.slice_starts(streams, 8)
        windows = {}
        for k, p in enumerate(lists):
            for i in range(len(p)):
                r = rank[begins[k] + i]
                assert (r >= 0) == (i + 8 <= len(p))
                if r >= 0:
                    windows.setdefault(tuple(p[i : i + 8]), set()).add((int(r), k))
        for w, seen in windows.items():
            (r,) = {r for r, _ in seen}
            assert names[r] == H.gram(list(w)) and on[r] == len({k for _, k in seen})


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_repeats_of_a_host_go_and_unique_runs_stay(spark):
    """Pages without an article: what a host repeats goes, in whatever slice it stands; copies and other hosts' texts stay."""
    rng = random.Random(2)
    menu, note = words(rng, 9), words(rng, 30)
    own = {i: [words(rng, rng.randrange(1, 60)) for _ in range(4)] for i in range(60)}
    tail = words(rng, 12)
    rows = [(i, f"http://A.example/{i}", f"<div>{menu}</div><p>{own[i][0]}<p>{own[i][1]}</p><div>{note}<div>{own[i][2]}<p>{own[i][3]}</div>") for i in range(60)]
    rows.append((60, "http://a.example/60", f"<div>{menu}</div><p>{note} {tail}</p>"))
    rows += [(100 + i, "http://a.example/copy", rows[7][2]) for i in range(40)]  # copies are one page
    rows += [(200, "http://b.example/", f"<p>{note}</p><p>own text</p>"), (201, None, f"<p>{note}"), (202, "no url", None)]
    near = words(rng, 300).split()
    rows += [(300 + i, "http://a.example/near", "<p>" + " ".join([*near[: 20 * i], "changed", *near[20 * i + 1 :]])) for i in range(5)]
    table = pages(spark, rows).repartition(7)
    want = {i: "\n\n".join(own[i]) for i in range(60)} | {60: tail} | {100 + i: "\n\n".join(own[7]) for i in range(40)} | {200: f"{note}\n\nown text", 201: note, 202: ""}
    want |= {300 + i: " ".join([*near[: 20 * i], "changed", *near[20 * i + 1 :]]) for i in range(5)}
    for chars in (H.SLICE_CHARS, 2000):
        assert dict(got(table, slice_chars=chars)) == want
    # by all windows of all pages of the host
    streams = sorted({"\n".join(t for _, t in H.page_blocks(h)) for _, u, h in rows if u and "a.example" in u.lower()})
    cover = dict(zip(streams, plain_cover(streams, H.RUN), strict=True))
    for i, u, h in rows:
        if u and "a.example" in u.lower():
            blocks = [t for _, t in H.page_blocks(h)]
            assert want[i] == "\n\n".join(x for x in H.kept_blocks(blocks, cover["\n".join(blocks)]) if x)


def test_doubtful_parts_of_an_article(spark):
    """A part that is only often boilerplate goes if the host repeats it, and stays if it is the page's own."""
    rng = random.Random(3)
    share = words(rng, 12)
    rows = [(i, "https://h.example/", f"<article><p>t{i}</p><div class='share-box'>{share}</div><div class=related>{words(rng, 12)}</div></article>") for i in range(3)]
    out = dict(got(pages(spark, rows)))
    assert all(share not in t and t.startswith(f"t{i}\n\nw") and len(t.split()) == 13 for i, t in out.items())


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "", ""), (1, "http://x/", "<article>a"), (1, "http://x/", "<article>a"), (2, "http://x/", "a\x00 b\x1f c"), (3, "x", "<p>" + "word " * 200_000)]
    table = pages(spark, rows).selectExpr("*", "'k' AS key", "1 AS text", "2 AS host", "3 AS blocks", "4 AS slice")
    out = got(table)
    assert sorted(t for _, t in out if len(t) < 99) == sorted(["a", "a", "", "a\x00 b c", ""])
    assert len(out) == 6 and H.main_texts(table.where("false")).count() == 0
    assert H.main_texts(table).columns == ["page_id", "url", "text", "n_chars"]
