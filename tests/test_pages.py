"""Pages and stylesheets: what is found in them, and what becomes of it when they are rewritten."""

from weftline.operators import css, html

BASE = "https://example.com/dir/page.html"


def found(text, base=BASE):
    page = html.read(text)
    return html.assets(page, text, html.base_of(page, base))


def test_links_by_tag():
    text = '<a href="/about">x</a><iframe src=f></iframe><a href="mailto:a@b">m</a><area href="r"><frame src="g"><META http-equiv=REFRESH content="0;url=/n">'
    assert [x[3] for x in html.links(html.read(text), BASE)] == [
        "https://example.com/about", "https://example.com/dir/r", "https://example.com/dir/f", "https://example.com/dir/g", "https://example.com/n"]


def test_base_element():
    page = html.read('<base href="/other/"><base href="/no/"><a href="x">x</a>')
    assert html.links(page, html.base_of(page, BASE))[0][3] == "https://example.com/other/x"


def test_assets():
    text = '<img src="a.png" srcset="b.png 1x,c.png"><link rel="Shortcut ICON" href="i.ico"><link rel="alternate stylesheet" href="s.css"><video><source src="v.mp4"><source src="w.mp4"></video><p style="background:URL(x.png)">'
    assert [(a[0].rpartition("/")[2], a[1]) for a in found(text)] == [("a.png", "image"), ("b.png", "image"), ("c.png", "image"), ("s.css", "stylesheet"), ("i.ico", "icon"), ("v.mp4", "video"), ("w.mp4", "video")]
    assert found('<p style="a:url(x.png)">')[0][1:] == ("image", "p", "style")


def test_scripts_hold_no_tags():
    assert not html.read("<script>var a = '<img src=x.png>';</script>").elements[1:]


def test_title():
    assert html.read("<title> A &eacute; </title><title>B</title>").title == "A é"
    assert html.read("<title></title>").title is None


def test_css():
    text = '@import url("a.css"); @import \'b.css\'; /* url(c.png) */ @font-face{src:url(d.woff2),url("e.xyz")} .x{background:url( f.png )} @media print{.y{background:url(g.png)} @import "h.css"}'
    got = [(a[0].rpartition("/")[2], a[1]) for a in css.assets(text, BASE)]
    assert got == [("a.css", "stylesheet"), ("b.css", "stylesheet"), ("d.woff2", "font"), ("e.xyz", "font"), ("f.png", "image"), ("g.png", "image"), ("h.css", "stylesheet")]


def test_css_survives_damage():
    for text in ("", "}", "@media {", "a { b: url(", "@import", "/* open", 'a { content: "', "))}{"):
        css.assets(text, BASE)
    assert css.assets("a { b: url(x\\29.png) }", BASE)[0][0].endswith("x).png")


def test_rewrite_page():
    local = {"/about": "about/index.html", "logo.png": "../a&b.png", "s.png": "t.png"}.get
    text = "<A HREF='/about' class=x>é</A><img alt=logo.png src=logo.png><img srcset='s.png 2x, z.png'><style>.a{b:url('s.png')}</style><a href=\"/else\">"
    assert html.rewrite(text, local) == "<A HREF='about/index.html' class=x>é</A><img alt=logo.png src=\"../a&amp;b.png\"><img srcset='t.png 2x, z.png'><style>.a{b:url('t.png')}</style><a href=\"/else\">"
    assert html.rewrite(text, lambda _: None) == text


def test_rewrite_css():
    local = {"a.css": "../a.css", "b.png": "../b.png"}.get
    assert css.rewrite("@import 'a.css'; x{y:url(\"b.png\")} z{w:url(c.png)}", local) == "@import '../a.css'; x{y:url(\"../b.png\")} z{w:url(c.png)}"


def test_tables_with_nulls_and_nothing(spark):
    from weftline.operators import extract, rewrite

    pages = spark.createDataFrame([(1, None, None), (2, BASE, ""), (3, BASE, "<a href=x>x</a>"), (3, BASE, "<a href=x>x</a>")], "page_id long, url string, html string")
    parsed = extract.parse_pages(pages)
    assert extract.links_of(parsed).count() == 2 and parsed.count() == 4
    assert extract.parse_pages(pages.limit(0)).count() == 0
    files = spark.createDataFrame([("pages/a.html", BASE, "html", "<meta charset=x><a href=b>"), ("n.html", None, "html", None)], "local_path string, base_url string, kind string, text string")
    empty = spark.createDataFrame([], "url string, target string")
    assert {r.local_path: r.text for r in rewrite.rewrite_files(files, empty).collect()}["pages/a.html"] == "<meta charset=x><a href=b>"
    some = spark.createDataFrame([("https://example.com/dir/b", "pages/b.html")], "url string, target string")
    assert {r.local_path: r.text for r in rewrite.rewrite_files(files, some).collect()}["pages/a.html"] == '<meta charset=UTF-8><a href="b.html">'
    loose = spark.createDataFrame([("https://EXAMPLE.com/dir/b?utm_source=x#y", "pages/b.html")], "url string, target string")
    assert {r.local_path: r.text for r in rewrite.rewrite_files(files, loose, "normalized").collect()}["pages/a.html"] == '<meta charset=UTF-8><a href="b.html">'


def test_pieces_put_together_on_the_jvm_equal_splicing(spark):
    """Random pages and stylesheets, rewritten as tables and one by one."""
    import random

    from weftline.functions.paths import relative_path
    from weftline.operators import rewrite

    rng = random.Random(7)
    urls = ["a.png", "/b.css", "c.html?x=1&amp;y=2", "https://o.example/d", "#top", "e f.png", "", "data:x", "it's.png"]
    tags = [
        lambda u: f'<a href="{u()}">t</a>', lambda u: f"<IMG SRC='{u()}' srcset=\"{u()} 1x,  {u()} 2x, ,{u()}\">", lambda u: f"<p style='a:url({u()}) ;b:url(\"{u()}\")'>", lambda u: f"<link href={u() or 'z'}>",
        lambda u: f'<style>@import "{u()}"; a{{b:url( {u()} )}} /* url({u()}) */</style>', lambda u: f'<video poster="{u()}" poster="{u()}"><source src="{u()}"></video>', lambda u: f'<p style="x:url(&quot;{u()}&quot;)">', lambda u: "<!-- <a href=a.png> -->é日\n"]
    files = []
    for k in range(120):
        text = "".join(rng.choice(tags)(lambda: rng.choice(urls)) for _ in range(rng.randrange(12)))
        files.append((f"pages/p{k}.html", "https://e.com/d/p.html", "html", text))
        files.append((f"assets/s{k}.css", "https://e.com/s.css", "css", "".join(rng.choice(["a{b:url(%s)}", "@import '%s';", "/* url(%s) */", 'x{y:URL( "%s" )}']) % rng.choice(urls) for _ in range(rng.randrange(6)))))
    found = {r.url for r in rewrite.find_references(spark.createDataFrame(files, "local_path string, base_url string, kind string, text string")).select("url").distinct().collect()}
    targets = {u: f"assets/{k}&\"'.png" for k, u in enumerate(sorted(found)) if k % 3}
    df = spark.createDataFrame(files, "local_path string, base_url string, kind string, text string")
    got = {r.local_path: r.text for r in rewrite.rewrite_files(df, spark.createDataFrame(list(targets.items()), "url string, target string")).collect()}
    from pyspark.sql import functions as F

    pairs = spark.createDataFrame([(p, t) for p, *_ in files for t in targets.values()], "p string, t string").select("p", "t", relative_path(F.col("p"), F.col("t")).alias("r"))
    relative = {(r.p, r.t): r.r for r in pairs.collect()}
    for path, base, kind, text in files:
        local = lambda raw: relative.get((path, targets.get(css.reference(raw, base))))  # noqa: E731, B023
        assert got[path] == (css if kind == "css" else html).rewrite(text, local), text
    assert sum(got[p] != t for p, _, _, t in files) > 100
