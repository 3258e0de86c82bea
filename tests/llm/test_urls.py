import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from epilode.llm import urls
from epilode.llm.queries import _HOST_RULES, _URL_RULES
from oracle import compare, connect

URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x", "http://www.example.com/EN/", "://a.net/es/",
    "x://b.net/esx/", "x://net/fr/?q#f", "x://net?/fr/", "x://net#/fr/", "x://anet/fr/", "x://a.net/fr", "http://user@a.net:80/es/", "x://y://net/es/",
    "http://m.ads-track.example.org/en/", "http://a.org/ads/1", "http://a.org/banner", "http://a.org/banners", "http://a.org/x?utm_campaign=1",
    "http://a.org/big.zip", "http://a.org/b\n.zip", "http://é.com/en/é", "http://a.example.com/en/ads/", "http://casino.org", "x://" + "a." * 20000 + "net/es/",
]


def brute(url):
    """(host, path, rule, verdict of the host rules)."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fits = []
    for rule, verdict in _HOST_RULES:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_host_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(n, u, "x", 1) for n, u in enumerate(URLS)], "page_id long, url string, host string, rule int")
    for rules, block in ((_URL_RULES, 100), (_URL_RULES, 2), (spark.createDataFrame(_URL_RULES), 3)):
        out = urls.judge(pages, rules, block=block)
        assert out.columns == [*pages.columns, "judged"]
        for r in out.collect():
            host, path, rule, verdict = brute(r.url)
            assert (r.judged.host, r.judged.path) == (host, path)
            if rule:
                assert (r.judged.rule, r.judged.verdict) == (rule, verdict)
            else:
                assert r.judged.tier != 1
    got = {r.url: (r.judged.rule, r.judged.verdict) for r in out.collect()}
    assert got["http://m.ads-track.example.org/en/"] == ("trackers", "block")
    assert got["http://a.org/banner"] == ("banners", "block") and got["http://a.org/banners"] == (None, "allow")
    assert got["http://a.org/b\n.zip"] == ("archives", "block") and got[None] == (None, "allow")
    with pytest.raises(ValueError):
        urls.judge(pages, _URL_RULES, into="rule")
    assert urls.judge(pages.where("false"), _URL_RULES).count() == 0
    assert {r.judged.verdict for r in urls.judge(pages, []).collect()} == {"allow"}


_PART = st.sampled_from(["a", "b", "/", ".", "*", "^", "é", "ab", "7"])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.lists(_PART, min_size=1, max_size=5).map("".join)), max_size=5), st.lists(_PART, max_size=8).map("".join))
def test_index_finds_every_rule_that_fits(patterns, target):
    rules = [urls.Rule(p, ("||" if anchored else "") + p, "block") for anchored, p in patterns]
    fits = [r for r in rules if urls.compile_pattern(r.pattern).match(target)]
    assert urls.RuleIndex(rules, {"a": 3, "b": 1}).best(target) == min(fits, key=urls.rank, default=None)


def test_rules_are_filed_under_their_rarest_token():
    index = urls.RuleIndex([urls.host_rule("a.b/c/", "block"), urls.Rule("open", "x*", "block")], {"a": 5, "b": 2, "c": 9})
    assert list(index.by_token) == ["b"] and len(index.always) == 1


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(entry.queries()["op7_urls"](spark, folder), connect(folder), entry.oracle_sql()["op7_urls"]) is None
