"""A small site of frames in a Japanese encoding, crawled from its responses to rewritten files."""

from weftline.config import CrawlConfig
from weftline.plans.site import archive_site
from weftline.sources.project import Project

HEAD = '<html><head><meta http-equiv="Content-Type" content="text/html; charset=Shift_JIS"><title>{}</title>'
INDEX = HEAD.format("表紙") + '</head><frameset cols="200,*"><frame src="menu.htm" name="left"><frame src="top.htm"></frameset></html>'
MENU = HEAD.format("目次") + '<link rel="stylesheet" href="style.css"></head><body><a href="top.htm">上</a><a href="about.htm">略歴</a><a href="https://other.example/x">x</a><a href="secret/a.htm">s</a></body></html>'
TOP = HEAD.format("俳優") + '</head><body><img src="photo.jpg"><img src="https://cdn.example/copy.jpg"><a href="gone.htm">g</a><a href="moved.htm">m</a></body></html>'
ABOUT = HEAD.format("略歴") + '</head><body style="background:url(back.png)">終</body></html>'


def test_frames(spark, tmp_path):
    site = "http://frames.example/"
    page = lambda name, text, status=200, final=None: (site + name, site + (final or name), status, "text/html", text.encode("cp932"))
    data = lambda url, kind, body: (url, url, 200, kind, body)
    rows = [
        page("", INDEX), page("menu.htm", MENU), page("top.htm", TOP), page("about.htm", ABOUT), page("gone.htm", "", 404), page("moved.htm", ABOUT, 200, "about.htm"), page("secret/a.htm", TOP),
        data(site + "style.css", "text/css", b"@import 'more.css'; body{background:url(back.png)} a{b:url(lost.png)}"), data(site + "photo.jpg", "image/jpeg", b"photo"),
        data("https://cdn.example/copy.jpg", "image/jpeg", b"photo"), data(site + "back.png", "image/png", b"back"), data(site + "more.css", "text/css", b""),
    ]
    responses = spark.createDataFrame(rows, "url string, final_url string, status int, content_type string, body binary")
    robots = spark.createDataFrame([("frames.example", "User-agent: *\nDisallow: /secret\n")], "host string, text string")
    config = CrawlConfig(start_url=site, project_name="frames", max_depth=3)
    found = archive_site(spark, responses, config, robots)
    paths = {r.url: r.local_path for r in found.url_map.collect()}
    assert paths == {
        site: "index.html", site + "menu.htm": "pages/menu.htm", site + "top.htm": "pages/top.htm", site + "about.htm": "pages/about.htm", site + "moved.htm": "pages/moved.htm",
        site + "style.css": "assets/style.css", site + "photo.jpg": "assets/photo.jpg", site + "back.png": "assets/back.png", site + "more.css": "assets/more.css",
        "https://cdn.example/copy.jpg": "external/cdn.example/copy.jpg"} or paths[site + "about.htm"] in ("pages/about.htm", "pages/moved.htm")
    assert {r.url for r in found.failed.collect()} == {site + "gone.htm", site + "secret/a.htm", site + "lost.png"}
    files = {r.local_path: r.text for r in found.files.collect()}
    assert '<frame src="pages/menu.htm"' in files["index.html"] and "表紙" in files["index.html"] and "charset=UTF-8" in files["index.html"]
    assert 'href="../assets/style.css"' in files["pages/menu.htm"] and '<a href="top.htm">' in files["pages/menu.htm"] and "https://other.example/x" in files["pages/menu.htm"]
    assert 'src="../assets/photo.jpg"' in files["pages/top.htm"] and 'src="../external/cdn.example/copy.jpg"' in files["pages/top.htm"]
    assert files["assets/style.css"] == "@import 'more.css'; body{background:url(back.png)} a{b:url(lost.png)}"
    assert not any("Shift_JIS" in t for t in files.values())
    assert sorted(r.local_path for r in found.bodies.collect()) == ["assets/back.png", "assets/photo.jpg"]
    assert [(r.local_path, r.canonical) for r in found.aliases.collect()] == [("external/cdn.example/copy.jpg", "assets/photo.jpg")]
    summary = found.summary.first()
    assert (summary.visited, summary.failed, summary.pending) == (len(paths), 3, 0)
    project = Project.create(spark, f"{tmp_path}/frames", config)
    found.save(project, config)
    assert Project.load(spark, f"{tmp_path}/frames").table("url_map").count() == len(paths)


def test_a_page_that_an_earlier_one_redirects_to_is_not_saved_again(spark):
    site = "http://moved.example/"
    page = lambda name, text, final=None: (site + name, site + (name if final is None else final), 200, "text/html", text.encode())
    rows = [page("", '<a href="a">1</a><a href="b">2</a><a href="c">3</a>'), page("a", '<a href="d">b</a>', "b"), page("b", '<a href="e">b</a>'), page("c", "c"), page("d", "d", "c"), page("e", "e")]
    responses = spark.createDataFrame(rows, "url string, final_url string, status int, content_type string, body binary")
    found = archive_site(spark, responses, CrawlConfig(start_url=site, project_name="moved"))
    paths = {r.url: r.local_path for r in found.url_map.collect()}
    # b is known by a's redirect, so it is not fetched and e is never found; d came last to c, and its file stands for both.
    assert set(paths) == {site, site + "a", site + "b", site + "c", site + "d"}
    assert paths[site + "a"] == paths[site + "b"] and paths[site + "c"] == paths[site + "d"] == "pages/d/index.html"
    assert {r.local_path for r in found.files.collect()} >= {"index.html", paths[site + "a"], paths[site + "d"]}
    assert found.failed.count() == 0
