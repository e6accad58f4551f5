"""Pages whose escaped titles are cut inside a character reference: every query over the parser's words and titles against its SQL."""

import html
from collections import Counter

import duckdb
import pytest

from pagelens.operators import parse
from pagelens.plans import site_catalog


def page(title: str, words: int) -> str:
    """A page of so many words, those of its heading included, as the SQL counts them."""
    said = len(title.replace("&amp;", " ").replace("&", " ").split())
    body = " ".join(f"w{i}" for i in range(words - said))
    return f"<!DOCTYPE html><html lang='en'><head><title>{title}</title></head><body><nav><a href='/a'></a></nav><h1>{title}</h1><p>{body}</p></body></html>"


#: Home pages of eight sites: whole and cut references, on either side of the 80 words under which a page is thin.
PAGES = [page("Ripe plums &amp; pears", 90), page("Ripe plums &amp;&amp", 80), page("Ripe plums &amp;&amp", 79), page("Ripe plums &am", 80), page("Ripe plums &amp", 120), page("Ripe plums &quot", 80), page("Ripe plums &amp;", 80), page("Ripe plums &#39", 81)]
#: Inner pages on either side of the 400 words that make one more important.
PAGES += [page("Ripe plums &amp;&amp", n) for n in (399, 400, 401)] + [page("Ripe plums &amp;", 400)]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """pages.parquet with ``PAGES`` and none else."""
    folder = tmp_path_factory.mktemp("references")
    rows = duckdb.connect()
    rows.execute("create table pages (page_id bigint, url varchar, html varchar)")
    rows.executemany("insert into pages values (?, ?, ?)", [[i, f"https://e.com/{i}", x] for i, x in enumerate(PAGES)])
    rows.execute(f"copy pages to '{folder}/pages.parquet'")
    return str(folder)


def both(spark, tables, name):
    """Rows of the query and of its SQL, with columns in one order."""
    rows = site_catalog.QUERIES[name](spark, tables)
    columns = sorted(rows.columns)
    sql = duckdb.connect()
    sql.execute(f"create view pages as select * from read_parquet('{tables}/pages.parquet')")
    return Counter(map(tuple, rows.select(*columns).collect())), Counter(sql.sql(site_catalog.ORACLES[name]).project(", ".join(columns)).fetchall())


def test_parsed_pages_with_cut_references(spark, tables):
    got, want = both(spark, tables, "parsed_pages")
    assert got == want and sum(got.values()) == len(PAGES)


def test_null_page_is_as_its_sql(spark, tmp_path):
    duckdb.sql(f"copy (select * from (values (0::bigint, 'https://e.com/', null::varchar), (1, null, ''), (2, null, '<p>a &amp b')) t(page_id, url, html)) to '{tmp_path}/pages.parquet'")
    got, want = both(spark, str(tmp_path), "parsed_pages")
    assert got == want and len(got) == 3


def test_only_whole_references_stand_for_something():
    cases = {"a &amp; b &amp c": "a & b &amp c", "&copy 2026": "&copy 2026", "&copy; 2026": "© 2026", "&#65;&#x42;&#67": "AB&#67", "&amp;amp; &amp;&amp": "&amp; &&amp", "&unknown; &notit; & &; &": "&unknown; &notit; & &; &"}
    assert {k: parse.resolved(k) for k in cases} == cases
    assert {k: parse.parse(f"<title>{k}</title><p>{k}", "https://e.com/")["title"] for k in cases} == cases
    got = parse.parse('<a href="/x?a=1&amp;b=2">go</a><script type="application/ld+json">{"@type": "A &amp; B &amp"}</script>' + html.escape("<'\">"), "https://e.com/")
    assert (got["internal_links"], got["jsonld_types"], got["text"]) == (["https://e.com/x?a=1&b=2"], ["A &amp; B &amp"], "go <'\">")


def test_page_role_with_cut_references(spark, tables):
    got, want = both(spark, tables, "page_role")
    assert got == want and sum(got.values()) == len(PAGES)


def test_site_findings_with_cut_references(spark, tables):
    got, want = both(spark, tables, "site_findings")
    columns = ["affected", "check_id", "confidence", "dimension", "priority", "priority_score", "reach", "sample", "severity", "site", "urls"]
    thin = {x["site"] for x in (dict(zip(columns, r, strict=True)) for r in got) if x["check_id"] == "thin_important_page"}
    assert got == want and thin == {"site2.example"}


def test_findings_ranked_with_cut_references(spark, tables):
    got, want = both(spark, tables, "findings_ranked")
    assert got == want and got


def whole(words: int, reference: str = "&eacute;") -> str:
    """A page with a whole reference inside a word, which the SQL counts as two words."""
    return page("Ripe plums", words - 1).replace("w0 ", f"caf{reference}s ")


#: On either side of 80 and of 400 words, with known and unknown references and one that a tag breaks.
WHOLE = [whole(n) for n in (79, 80, 81, 399, 400, 401)] + [whole(n, x) for n in (80, 400) for x in ("&#x27;", "&#233;", "&unknown;", "&am<b>p;</b>")]


@pytest.fixture(scope="module", params=[0, 2**53 + 1, -9, 10**12], ids=["plain", "beyond doubles", "below zero", "far"])
def shifted(request, tmp_path_factory):
    """Ten pages of every kind in ``WHOLE``, their ids shifted; ids below zero have pages without an address among them."""
    folder = tmp_path_factory.mktemp("whole")
    rows = duckdb.connect()
    rows.execute("create table pages (page_id bigint, url varchar, html varchar)")
    rows.executemany("insert into pages values (?, ?, ?)", [[i + request.param, f"https://e.com/{i}", WHOLE[i * 5 % len(WHOLE)]] for i in range(10 * len(WHOLE))])
    rows.execute(f"copy pages to '{folder}/pages.parquet'")
    return str(folder)


def test_page_role_with_whole_references_and_any_ids(spark, shifted):
    got, want = both(spark, shifted, "page_role")
    assert got == want and sum(got.values()) == 10 * len(WHOLE)


def test_site_findings_with_whole_references_and_any_ids(spark, shifted):
    got, want = both(spark, shifted, "site_findings")
    assert got == want and got


def test_findings_ranked_with_whole_references_and_any_ids(spark, shifted):
    got, want = both(spark, shifted, "findings_ranked")
    assert got == want and got


def test_references_part_words_and_stand_in_texts():
    got = parse.parse("<p>caf&eacute;s don&#x27;t &unknown;x <b>&am</b>p; a&amp b</p>", "https://e.com/")
    assert (got["text"], got["words"]) == ("cafés don't &unknown;x &am p; a&amp b", 10)
