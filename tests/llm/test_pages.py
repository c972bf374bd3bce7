import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from quernel.llm import fixity, html_text, oracles, url_rules

PAGES = "page_id bigint, url string, html string, host string, rule string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash", "clash") for i, u, h in rows], PAGES)


# URL rules


def verdict(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail.split("?")[0].split("#")[0]
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    fit = [r for r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    best = max(fit, key=len, default=None)
    return host, path, (best, rules[best]) if best else None


def test_rules(spark):
    rng = random.Random(2)
    urls = [None, "", "no scheme", "://", "x://", "http://EXAMPLE.Com/en/725?x#y", "http://a.example.com?/en/7", "http://com/en/", "http://notexample.com/en/7", "http://xcom/en/1", "http://a.com/EN/1", "a://b.com/en/x://c", "http://example.com#/en/", "http://ex.com:80/en/1", "http://é.com/en/é"]
    hosts = ["com", "a.com", "example.com", "www.example.com", "badexample.com", "example.net", "m.example.net", "net", "x.org", "casino-win.org", "ads.example.net"]
    urls += [f"https://{rng.choice(hosts)}{rng.choice(['/en/7', '/en/8', '/de/8', '/de/', '/es/1', '/en', '/e/n/', ''])}{rng.choice(['', '/x', '?q', '#f', '9'])}" for _ in range(200)]
    rows = [(i if i % 7 else None, u, "") for i, u in enumerate(urls)] + [(1, urls[5], "")] * 2
    got = url_rules.judge(pages(spark, rows).withColumn("html", F.col("url"))).collect()
    assert len(got) == len(rows)
    want = sorted(repr((i, *verdict(u)[:2], (verdict(u)[2] or (None,))[0])) for i, u, _ in rows)
    assert sorted(repr((r.page_id, r.host, r.path, r.rule)) for r in got) == want
    for r in got:
        if r.rule:
            assert r.verdict == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}[r.rule]
        else:
            assert r.verdict == ("block" if "casino-win" in r.host or r.host.startswith("ads.") else "allow")
    assert url_rules.judge(pages(spark, []).limit(0)).collect() == []


def test_every_rule_on_every_url(spark):
    """Fetching rules by their rarest token gives what running each rule on each URL gives."""
    import re

    rng = random.Random(6)
    words = [r.name.split(":")[1] for r in url_rules.WORDS] + ["a", "news", "x1", "Login", "CART", "en", "example", "blog-ads", "poker2"]
    part = lambda: rng.choice(words)
    urls = []
    for _ in range(1500):
        path = "".join("/" + part() + rng.choice(["", "", ".html", "-x", "/"]) for _ in range(rng.randint(0, 3)))
        query = rng.choice(["", "", f"?{part()}=1", f"?a=b&{part()}=2&c", f"?{part()}", f"#{part()}="])
        urls.append(f"http://{rng.choice(['', 'www.', part() + '.', part() + '-'])}{part()}{rng.choice(['.com', '.net', '.org', ':80'])}{path}{query}")
    got = {r.page_id: r for r in url_rules.judge(pages(spark, [(i, u, "") for i, u in enumerate(urls)])).collect()}
    low = str.maketrans(url_rules.UPPER, url_rules.LOWER)
    verdicts = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1].split("#")[0]
        cut = min([rest.find(c) for c in "/?" if c in rest] or [len(rest)])
        place = rest[:cut].translate(low) + rest[cut:]
        fit = [r for r in url_rules.CONTRACT if re.search(r.pattern, place)]
        if fit:
            best = max(fit, key=lambda r: len(r.name))
            want = (best.name, best.verdict)
        else:
            want = (None, "block" if any(re.search(r.pattern, place.translate(low)) for r in url_rules.WORDS) else "allow")
        assert (got[i].rule, got[i].verdict) == want, u
        verdicts.append(want[1])
    assert len(url_rules.WORDS) > 100 and 200 < verdicts.count("allow") < 1300
    db = duckdb.connect()
    db.execute("create table pages(page_id bigint, url varchar)").executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    assert sorted(db.sql(oracles.URL_SQL).fetchall(), key=repr) == sorted(map(tuple, got.values()), key=repr)


def test_a_very_long_url(spark):
    url = "http://a.com/" + "x/" * 300_000 + "login?q"
    assert url_rules.judge(pages(spark, [(1, url, "")])).first().verdict == "block"


# fixity


def test_audit_finds_each_damage(spark):
    rows = [(i, f"http://h/{i}", f"body {i}" * (i % 9)) for i in range(0, 9000, 3)] + [(None, None, None), (None, "u", "h"), (12, "twin", "x"), (12, "twin", "x")]
    ours = pages(spark, rows)
    theirs = [r for r in rows if r[0] != 300] + [(5000, "new", "extra")]
    theirs = [(i, u, h + "!" if i in (6, 8100) else h) for i, u, h in theirs]
    theirs.remove((12, "twin", "x"))
    got = fixity.audit(ours, pages(spark, theirs)).collect()
    bad = {r.key: r.status for r in got if r.status != "ok"}
    assert bad == {300: "missing", 5000: "extra", 6: "corrupt", 8100: "corrupt", 12: "corrupt"}
    by = {r.key: r for r in got}
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:3>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: http://h/3\r\nContent-Type: text/html\r\nContent-Length: 18\r\n\r\nbody 3body 3body 3\r\n\r\n"
    assert by[3].sha256 == hashlib.sha256(record).hexdigest() and by[3].n_bytes == len(record) and by[3].offset == by[0].n_bytes
    assert all(r.status == "ok" for r in fixity.audit(ours, ours).collect())
    assert fixity.audit(ours.limit(0), ours.limit(0)).collect() == []
    assert {r.status for r in fixity.audit(ours.limit(0), ours).collect()} == {"extra"}


def test_volumes_on_disk(spark, tmp_path):
    """Records written as WARC files are read back from their bytes; a flipped byte and a lost file are located."""
    rows = [(i, f"http://h/{i}" if i % 5 else None, f"body é {i}\r\n\r\nWARC/1.1\r\n" * (i % 4)) for i in range(0, 300)] + [(300, "u\r\nX: y", None), (301, "long", "z" * 2_000_000), (None, "n", "null id")]
    ours = pages(spark, rows)
    p = fixity.Params(fanout=4, levels=2)
    fixity.write_volumes(ours, f"file://{tmp_path}/w", p)
    back = fixity.read_volumes(spark, f"file://{tmp_path}/w", p)
    want = fixity.records(ours, p)
    assert sorted(back.select(want.columns).collect()) == sorted(want.collect())
    by = {r.key: r for r in back.collect()}
    assert by[7].payload.decode() == rows[7][2] and by[7].uri == "http://h/7" and by[0].uri is None and by[300].uri == "u%0D%0AX: y"
    files = {f.parent.name: f for f in tmp_path.glob("w/volume=*/part*")}
    data = bytearray(files["volume=6"].read_bytes())
    at = data.index(b"body \xc3\xa9 102")
    data[at] ^= 1
    files["volume=6"].write_bytes(data)
    files["volume=9"].unlink()
    for f in tmp_path.glob("w/volume=*/.*.crc"):
        f.unlink()
    got = fixity.audit_records(want, fixity.read_volumes(spark, f"file://{tmp_path}/w", p), p)
    assert {r.key: r.status for r in got.filter("status != 'ok'").collect()} == {102: "corrupt"} | {k: "missing" for k in range(144, 160)}


def test_a_lost_record_only_changes_the_nodes_above_it(spark):
    rows = [(i, "u", f"{i}") for i in range(256)]
    p = fixity.Params(fanout=4, levels=4)
    levels = [fixity.tree(fixity.slots(fixity.records(pages(spark, x), p)), "t", p) for x in (rows, [r for r in rows if r[0] != 37])]
    differing = [{r.node for r in fixity._differing(a, b, "node").collect()} for a, b in zip(*levels)]
    assert differing == [{37 // 4}, {37 // 16}, {37 // 64}, {0}]
    moved = fixity.records(pages(spark, rows), p).withColumn("n_bytes", F.when(F.col("slot") == 40, F.col("n_bytes") + 1).otherwise(F.col("n_bytes")))
    assert [r.node for r in fixity._differing(levels[0][0], fixity.tree(fixity.slots(moved), "t", p)[0], "node").collect()] == [10]  # ranges count too


def test_many_records_with_one_key(spark):
    rows = [(5, "u", f"{i}") for i in range(500)]
    ours, theirs = pages(spark, rows), pages(spark, rows[1:] + [(5, "u", "other")])
    assert [r.status for r in fixity.audit(ours, ours).collect()] == ["ok"] and [r.status for r in fixity.audit(ours, theirs).collect()] == ["corrupt"]


def test_audit_sql(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    table = spark.read.parquet(path)
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{path}'")
    assert sorted(map(tuple, fixity.audit(table, fixity.damaged(table)).collect())) == sorted(db.sql(fixity.AUDIT_SQL).fetchall())


# HTML


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="sidebar"><header>h</header><nav><ul><li>menu</ul></nav>
    <div class="cookie-notice">c</div><article class="post"><h1>A &amp; B&nbsp;&eacute;&#8364;</h1><p>one <b>two</b>three<br>four<p>five <!-- gone --><script>var t="</p>";</script>
    <ul><li>a<li>b</ul><div class="adBanner">ad</div><form>f</form><table><tr><td>x<td>y</table><section id="comments">c</section></article><aside>z</aside><footer>&copy;</footer></body></html>"""
    assert html_text.main_text(page) == "A & B é€ one twothree four five a b x y"
    for page, want in ((None, ""), ("", ""), ("<p>a</p>b<b>c", "a bc"), ("a < b &lt; c", "a < b < c"), ("<main><article>x</article> y</main>z", "x y"), ("<article>1</article><p>no</p><article>2</article>", "1 2"), ("<article><p>un<b>closed", "unclosed")):
        assert html_text.main_text(page) == want
    assert len(html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000)) == 4


def test_site_templates_go(spark):
    shell = "<div><p>Our site since 1999</p></div><div><h2>{0}</h2><p>story {0} of {1}</p></div><p>All rights kept</p>"
    rows = [(i, f"http://{h}/{i}", shell.format(i, h)) for h in ("a.org", "b.org") for i in range(8)] + [(50, "http://c.org/1", shell.format(1, "c")), (None, None, None), (51, "http://a.org/x", "<article><p>Our site since 1999</p></article>"), (51, "http://a.org/x", "<article><p>Our site since 1999</p></article>")]
    got = html_text.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None and r.page_id < 8:
            host = r.url.split("/")[2]
            assert r.text == f"{r.page_id} story {r.page_id} of {host}"
        assert r.n_chars == len(r.text)
    by = {r.page_id: r.text for r in got}
    assert by[50] == "Our site since 1999 1 story 1 of c All rights kept"  # one page is no template
    assert by[None] == "" and by[51] == "Our site since 1999"
    assert html_text.extract(pages(spark, rows).limit(0)).collect() == []


def test_templates_inside_articles_go(spark):
    story = "<h1>Tale {0}</h1><p>what <b>really</b> came of number {0} is told in many words here</p><table><tr><td>yes<td>{0}</table>"
    block = "<div><p>Read our morning letter</p></div>"
    page = "<article>" + story + block + "</article><article><p>Other tales</p></article>"
    rows = [(i, f"http://a.org/{i}", page.format(i)) for i in range(8)] + [(20 + i, f"http://b.org/{i}", f"<main>{story.format(i)}</main>") for i in range(8)]
    # a large host: a block on 100 of 600 pages, under the share; copies of one article at many URLs and with an edit
    rows += [(1000 + i, f"http://c.org/{i}", f"<article>{story.format(i)}{'<div>More from c</div>' if i < 100 else ''}</article>") for i in range(600)]
    rows += [(100 + i, f"http://d.org/{i}", "<article>" + story.format(1) + "</article>") for i in range(9)]
    rows += [(200 + i, f"http://e.org/{i}", "<article>" + story.format(1) + f"<p>edit {i}</p></article>") for i in range(9)]
    rows += [(3000 + i, f"http://f.org/{i}", f"<div><p>tale {i}</p></div>{'<div>Section one</div>' if i < 100 else ''}") for i in range(600)]
    # a line that articles of all hosts quote
    rows += [(2000 + i, f"http://{i % 20}.org/{i}", f"<article>{story.format(i)}{'<p>All is well</p>' if i // 20 < 8 else ''}</article>") for i in range(600)]
    told = "Tale {0} what really came of number {0} is told in many words here yes {0}"
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert all(got[i] == told.format(i) and got[20 + i] == told.format(i) for i in range(8))
    assert all(got[1000 + i] == told.format(i) for i in range(600))
    assert all(got[3000 + i] == f"tale {i}" for i in range(600))
    assert all(got[2000 + i] == told.format(i) + (" All is well" if i // 20 < 8 else "") for i in range(600))
    assert all(got[100 + i] == told.format(1) and got[200 + i] == told.format(1) + f" edit {i}" for i in range(9))


def test_articles_of_the_tables(spark):
    import html
    import re

    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(table).collect()}
    for r in table.collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(?:p|h1|br)>", " ", body))).split())


def test_names_do_not_empty_articles():
    for page, want in (
        ('<main class="with-sidebar">one two</main>', "one two"),
        ('<article class="post has-comments">text <p>more</p></article>', "text more"),
        ('<div class="ad-free">all of it</div>', "all of it"),
        ('<article>see <a class="related-link">this</a><section id="related-work"><p>work</p></section></article>', "see this work"),
        ('<article class="comment">main</article>', "main"),
        ('<article>a<div class="comments-area">c</div><div id="site-footer">f</div><div class="ad-slot-3">x</div><span class="ad">y</span><article class="comment">z</article></article>', "a"),
    ):
        assert html_text.main_text(page) == want, page


def test_templates_alone_remove_what_recurs(spark):
    """Without name rules and without the article rule: recurring blocks of sf0.1 go, and no article text does."""
    import re
    from collections import Counter, defaultdict

    p = html_text.Params(names=False, guard=False)
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(table, p).collect()}
    whole = {r.page_id: r.text for r in html_text.extract(table).collect()}
    holds, blocks = defaultdict(set), {}
    for r in table.collect():
        host = re.sub(r"^.*?://([^/?#]*).*", r"\1", r.url).lower()
        blocks[r.page_id] = [(host, b) for b in re.findall(r"<nav>.*?</nav>|<footer>.*?</footer>|<div class=\"ad\">.*?</div>", r.html, re.S)]
        for b in blocks[r.page_id]:
            holds[b].add(whole[r.page_id])
    often = {b for b, texts in holds.items() if len(texts) >= p.least_pages}
    assert len(often) >= 100
    for i, text in got.items():
        assert whole[i] in text
        left = text.replace(whole[i], "", 1).split()
        rest = [html_text.main_text(b, (), p) for b in (x for _, x in (k for k in blocks[i] if k not in often))]
        assert Counter(left) <= Counter(" ".join(rest).split()), i  # items of other menus may recur on their own


def test_many_templates_are_joined_by_page(spark, monkeypatch):
    shell = "<div><p>Our site since 1999</p></div><article><p>story {0}</p></article><p>All rights kept {1}</p>"
    rows = [(i, "http://a.org/1", shell.format(i, i % 2)) for i in range(12)] + [(99, None, "<p>Our site since 1999</p>"), (99, None, "<p>Our site since 1999</p>")]
    p = html_text.Params(names=False, guard=False)
    want = sorted(map(tuple, html_text.extract(pages(spark, rows), p).collect()), key=repr)
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, html_text.extract(pages(spark, rows), p).collect()), key=repr) == want
    assert [r[2] for r in want if r[0] == 3] == ["story 3"] and [r[2] for r in want if r[0] == 99] == ["Our site since 1999"] * 2


def test_a_very_long_page(spark):
    page = "<article>" + "<p>word and word</p>" * 150_000 + "</article>"
    row = html_text.extract(pages(spark, [(1, "http://h/1", page)])).first()
    assert row.n_chars == 150_000 * 14 - 1 and row.text.startswith("word and word word")
