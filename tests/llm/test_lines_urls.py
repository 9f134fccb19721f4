import pytest

from tablescout.llm import line_dedup, url_rules
from tablescout.llm.queries import URL_RULES
from tests.llm import brute

LONG = "A line that is long enough to count"
ROWS = [
    (1, f"  {LONG}  \nshort\n{LONG.upper()}\nkept one"),
    (2, f"{LONG}\r\nother text of twenty chars"),
    (3, f"{LONG}"),
    (3, f"{LONG}"),
    (3, f"first\n{LONG}\nlast"),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (None, f"{LONG}\n{LONG}"),
    (7, "Ünïcödé línes hàve äccents\nExactly twenty chars"),
    (8, "üNÏCÖDÉ LÍNES HÀVE ÄCCENTS\nexactly twenty chars"),
    (9, "exactly twenty chars\n nineteen characters "),
    (10, "nineteen characters\nother text of twenty chars"),
    (11, "nineteen characters\nother text of twenty chars"),
    (12, "\n".join([f"only here number {i} of very many" for i in range(3_000)] + [LONG] * 200)),
]


def test_lines_drop_like_brute_force(spark):
    rows = [(i, t, "keep") for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string").repartition(3)
    out = line_dedup.drop_lines(docs).collect()
    expected = [(repr(i), n, gone, kept) for (i, _), (n, gone, kept) in zip(ROWS, brute.dedup_lines(ROWS), strict=True)]
    assert sorted((repr(r.doc_id), r["__n_lines"], list(r["__dropped"]), r.text) for r in out) == sorted(expected)
    assert {r.line for r in out} == {"keep"}


def test_bitmaps_hold_only_words_with_a_loss(spark):
    docs = spark.createDataFrame([(i, "x\n" * 130 + LONG) for i in range(4)], "doc_id long, text string")
    out = {(r.doc, r.word, r.bits) for r in line_dedup.keep_bitmaps(docs).collect()}
    assert out == {(i, 2, 1 << 2) for i in range(3)}


def test_the_sixty_fourth_line_of_a_word(spark):
    docs = spark.createDataFrame([(i, "x\n" * 63 + LONG) for i in range(3)], "doc_id long, text string")
    assert [list(r["__dropped"]) for r in line_dedup.drop_lines(docs).orderBy("doc_id").collect()] == [[63], [63], []]


def test_no_documents(spark):
    assert line_dedup.drop_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


URLS = [
    None, "", "no scheme", "http://", "http:///path", "http://com/", "https://A.COM/x", "https://com", "https://xcom/",
    "https://example.com/en", "https://example.com/en/", "https://www.example.com/en/1", "https://WWW.EXAMPLE.com/EN/1",
    "https://notexample.com/en/1", "https://example.com/en/?q=a/b#c", "https://a.net/es/x", "https://a.net/fr/",
    "https://a.net/esx", "ftp://x.net/fr/?://b.com/", "https://a.net:80/es/x", "https://a b.example.com/en/x\ny",
    "https://é.com/ä", "https://com/#a/b", "https://user@example.com/en/", "x://y://example.com/en/",
]


def test_urls_are_judged_like_brute_force(spark):
    rows = [(i, u, "html") for i, u in enumerate(URLS)] + [(None, URLS[6], ""), (0, URLS[6], ""), (0, URLS[6], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = url_rules.judge_urls(pages, URL_RULES).collect()
    got = sorted((repr(r.page_id), r.host, r.path, repr(r.rule), r.verdict) for r in out)
    expected = [(repr(i), *brute.url_verdict(u, URL_RULES)) for i, u, _ in rows]
    assert got == sorted((i, h, p, repr(r), v) for i, h, p, r, v in expected)


def test_many_rules_and_rules_with_signs(spark):
    rules = [("block", f"site{i}.org/a.b(c/") for i in range(300)] + [("allow", "org/"), ("block", r"q.org/\E[x/")]
    urls = ["http://site7.org/a.b(c/d", "http://site7.org/aXb(c/d", "http://x.site299.org/a.b(c/", r"http://q.org/\E[x/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = [(r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).orderBy("page_id").collect()]
    assert out == [brute.url_verdict(u, rules) for u in urls]


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in url_rules.judge_urls(pages, []).collect()] == [(1, "a.com", "/", None, "allow")]
    assert url_rules.judge_urls(pages.where("false"), URL_RULES).collect() == []
    with pytest.raises(ValueError, match="literal token"):
        url_rules.judge_urls(pages, [("block", "./")])


def test_judging_runs_no_python_and_no_join(spark):
    plan = url_rules.judge_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), URL_RULES)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Join" not in text and "Exchange" not in text
