"""The links of pages against the standard library's HTML parser and url functions."""

import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from wiregraph.llm import urls


class Tags(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.found.append(a.get("href", ""))
        if tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh":
            m = re.match(r"""\s*[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*).*|'([^']*).*|(.*))$""", a.get("content", ""), re.I | re.S)
            if m:
                self.found.append(next(x for x in m.groups() if x is not None))

    handle_startendtag = handle_starttag


def node(url):
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", url):
        return None
    s = urlsplit(url)
    host, scheme = s.netloc.lower(), s.scheme.lower()
    port = {"http": ":80", "https": ":443"}.get(scheme)
    host = host[: -len(port)] if port and host.endswith(port) else host.removesuffix(":")
    parts, out = s.path.split("/"), []
    for p in parts:
        if p == "..":
            out = out[:-1] if len(out) > 1 else out
        elif p != ".":
            out.append(p)
    path = "/".join([*out, ""] if parts[-1] in (".", "..") else out) if {".", ".."} & set(parts) else s.path
    return f"{scheme}://{host}{path or '/'}" + (f"?{s.query}" if s.query else "")


def plain(url, html):
    t = Tags()
    t.feed(html)
    t.close()
    found = (re.sub(r"[\t\r\n]", "", x).strip() for x in t.found)
    return {(node(url), v) for x in found if x and not x.startswith("#") for v in [node(urljoin(url, x))] if v and v != node(url)}


CASES = [
    "<meta http-equiv=\"refresh\" content=\"0; url=http://n.net/?a=1&amp;b=2;c\">", "<META HTTP-EQUIV='Refresh' CONTENT=\"5;URL='http://n.net/a b'\">", "<meta http-equiv=refresh content=0;url=/r>", "<meta http-equiv=refresh content='3'>", "<meta http-equiv=refresh content='0, http://n.net/z'>",
    '<link rel="canonical" href="/y?next=http://q.net/">', '<link rel=canonical href="../c">', "<link href='../../../d/./e/..' rel='canonical nofollow'>", '<link rel="canonical" href="?p=2">', '<link rel="canonical" href="#top">', '<link rel="canonical" href="">', '<link rel=canonical>',
    '<link data-href="http://bad.net/" href="http://good.net/" rel="x CANONICAL">', "<link rel=canonical href=HTTP://P.net:80/x?y=1>", '<link rel=canonical href="https://p.net:443">', '<link rel=canonical href="http://p.net:8080/x/">', '<link rel=canonical href="//o.net/%41?z#f"/>', '<link rel=canonical href="mailto:a@b.c">', "<link rel=canonical href='http://o.net/a>b'>",
    "<!-- <link rel=canonical href=http://c.net/> -->", "<!-- <meta http-equiv=refresh content='0;url=http://c.net/'> --><link rel=canonical href=http://after.net/>", "<script>var x = '<link rel=canonical href=http://s.net/>'</script>", '<link rel="stylesheet" href="http://css.net/">', '<linkx rel=canonical href="http://x.net/">', '<link\n  rel = "canonical"\n  href = " http://white.net/q\n1 ">', '<link rel=canonical href="http://one.net/" href="http://two.net/">', "text only", "",
]
BASES = ["http://a.com/x/y.html?q=1#f", "https://A.com", "http://a.com:80/x/../y/", "http://a.com/only?x=/a/b", "HTTP://a.com/./z"]


def test_links(spark):
    random.seed(1)
    pages = [(b, h) for b in BASES for h in CASES] + [(random.choice(BASES) + str(i), "<html>" + "\n".join(random.sample(CASES, 4)) + "</html>") for i in range(60)]
    got = {tuple(r) for r in urls.links(spark.createDataFrame([*pages, (None, CASES[0]), ("http://a.com/", None), ("no scheme", CASES[0])], "url string, html string")).collect()}
    want = {e for u, h in pages for e in plain(u, h)}
    assert (got - want, want - got) == (set(), set()) and len(want) > 100


def test_blocks_reach_through_links(spark):
    """Links as people write them, each to a blocked url: every page is blocked but for the link in a comment."""
    tags = ["<meta http-equiv=refresh content='0; url=http://{0}.n.com/de/?a=1&amp;b=2'>", '<link rel="canonical" href="http://{0}.n.com/de/c?next=http://q.net/">', "<link rel=canonical data-href=http://q.net/ href=http://{0}.n.com:80/x/../de/>", "<!-- <link rel=canonical href=http://{0}.n.com/de/> -->"]
    pages = [(i, f"http://p{i}.net/a/b", t.format(f"h{i}")) for i, t in enumerate(tags)]
    pages += [(10, "http://r.net/a/b", '<link rel=canonical href="../c">'), (11, "http://r.net/c", tags[0].format("r")), (12, "http://r.net/d/e?x", '<link rel=canonical href="?p=2">'), (13, "http://r.net/d/e?p=2", tags[0].format("s")), (14, "http://r.net:80/f", ""), (15, "http://r.net/f", tags[1].format("t"))]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "allow" if i == 3 else "block" for i, _, _ in pages}
