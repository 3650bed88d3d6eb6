import duckdb
import pytest

from octroi.llm.queries import URL_RULES
from octroi.llm.url_templates import checking_sql, filter_urls

URLS = [
    None, "", "no scheme/en/1", "://", "http://", "http://EXAMPLE.com", "http://Example.COM/en/", "https://www.example.com/en/x?u=://a", "http://a.www.example.com/en/1#f", "http://notexample.com/en/1",
    "http://x.net/es/1", "http://net/fr/9", "http://net/FR/9", "ftp://x.net?/es/1", "http://x.net#/es/1", "http://xnet/es/1", "http://É.com/é/1", "http://a.org//b/c/d/e", "http://a.org/b/c/d/", "x://y://z.com/en/", "http://u:p@h.com:80/q",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u) for i, u in enumerate(URLS)]
    for i in range(400):
        rows.append((100 + i, f"http://h{i % 3}.{'com' if i % 2 else 'net'}/{['es', 'en', 'fr', 'shop'][i % 4]}/{['item', 'list'][i % 5 > 1]}/{i}.html"))
        rows.append((600 + i, f"http://h{i % 3}.example.com/{['es', 'en'][i % 2]}/{['item', 'list'][i % 7 > 2]}/{i}/{'' if i % 2 else i}"))
    rows += [rows[5], (None, "http://x.net/es/1"), (None, None)]
    return spark.createDataFrame([(*r, "v", 1) for r in rows], "page_id long, url string, verdict string, n int")


def spec(url):
    """Host, path and rule by plain string work."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(pages):
    rows = {(r.page_id, r.url) for r in pages.collect()}
    want = {(i, *spec(u)[:3]) for i, u in rows}
    got = filter_urls(pages, URL_RULES).collect()
    assert {(r.page_id, r.host, r.path, r.rule) for r in got} == want and len(got) == pages.count()
    verdicts = {(i, *spec(u)[:2]): spec(u)[3] for i, u in rows}
    assert all(r.verdict == verdicts[r.page_id, r.host, r.path] for r in got if r.rule)
    assert {r.verdict for r in got} == {"allow", "block"}


def test_equals_its_sql(pages):
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    want = con.execute(checking_sql(URL_RULES)).fetchall()
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.template) for r in filter_urls(pages, URL_RULES).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_templates_reject_by_purity(spark):
    rows = [(i, f"http://s.org/ads/{i}") for i in range(40)] + [(100 + i, f"http://s.org/doc/{i}") for i in range(40)]
    rules = [("block", "s.org", f"/ads/{d}") for d in (1, 2)] + [("allow", "s.org", f"/doc/{d}") for d in (1, 2, 3)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert {(r.template, r.verdict) for r in got} == {("/ads/*", "block"), ("/doc/*", "allow")}


def test_alike_branches_merge(spark):
    rows = [(i, f"http://s.org/{'abcd'[i % 4]}/{i}") for i in range(80)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "s.org", "/")]).collect()
    assert {r.template for r in got} == {"/~/*"}


@pytest.mark.parametrize("sections", [5, 25, 60])
def test_a_blocked_section_is_rejected_on_hosts_of_any_size(spark, sections):
    rows = [(i, f"http://s.org/s{i % sections}/{i}") for i in range(40 * sections)]
    rules = [("block", "s.org", f"/s3/{3 + sections * k}") for k in range(30, 40)] + [("allow", "s.org", f"/s{s}/") for s in (0, 1)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert {r.verdict for r in got if r.path.startswith("/s3/")} == {"block"} and {r.verdict for r in got if not r.path.startswith("/s3/")} == {"allow"}


def test_branches_part_at_any_depth(spark):
    paths = {"ads": "/en/a/b/ads", "doc": "/en/a/b/doc", "far ads": "/en/q/b/c/d/e/ads", "far doc": "/en/q/b/c/d/e/doc", "long ads": "/en/z/b/c/x", "doc ended": "/en/z/b"}
    kinds = list(paths)
    rows = [(100 * k + i, f"http://s.org{paths[kind]}/{i}") for k, kind in enumerate(kinds) for i in range(40)]
    rules = [("block" if "ads" in kind else "allow", "s.org", f"{paths[kind]}/{d}") for kind in kinds for d in (1, 2)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert sorted(r.page_id for r in got) == [r[0] for r in rows]
    for k, kind in enumerate(kinds):
        assert {r.verdict for r in got if r.page_id // 100 == k} == {"block" if "ads" in kind else "allow"}, kind


def test_empty(pages):
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0
