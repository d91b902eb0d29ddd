import pytest

from kinlink.llm import registry, url_filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return host, path[:end]


def rule_of(host, path):
    best = None
    for what, h, p in registry.URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = what, h + p
    return best or (None, None)


URLS = [
    "http://A.Example.ORG/es/1?x#y", "https://example.org/en/1", "https://example.org/en/2", "https://notexample.org", "http://x.com/fr/9", "http://x.com/de/9#z", "com/de/", None, "", "://", "http://",
    "ftp://HOST.net?q=/a", "http://a.b.com#f/de/", "x://y://z.com/de/", "http://exämple.org/ß", "http://fexample.org/es/", "http://h.com/de/" + "a" * 50_000, "line\nhttp://q.com/fr/\nx",
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    none = spark.createDataFrame([], "id long, bad int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, none, registry.URL_RULES).collect()}
    for i, u in enumerate(URLS):
        host, path = parts(u)
        verdict, rule = rule_of(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or "allow")
    assert url_filter.judge(pages.limit(0), none, registry.URL_RULES).count() == 0


def test_reputation_blocks_bad_hosts_only(spark):
    pages, outcomes = [], []
    for i in range(600):
        host = ["bad.spam.net", "good.fine.net", "mixed.net", "new.spam.net"][i % 4]
        pages.append((i, f"http://{host}/{i}"))
        if i % 4 != 3:
            outcomes.append((i, [1, 0, i % 8 // 4][i % 4]))
    pages += [(1000, "http://rare.info/"), (1001, "http://other.org2/"), (0, "http://bad.spam.net/0")]
    outcomes += [(1000, 1), (None, 1), (5000, 1), (1, None), (0, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = url_filter.judge(df, spark.createDataFrame(outcomes, "id long, bad int"), []).collect()
    verdict = {r["host"]: r["verdict"] for r in got}
    assert verdict["bad.spam.net"] == "block" and verdict["good.fine.net"] == "allow" and verdict["mixed.net"] == "allow"
    assert verdict["new.spam.net"] == "block" and verdict["rare.info"] == "allow" and verdict["other.org2"] == "allow"
    assert len(got) == len(pages)


@pytest.mark.parametrize("bad", [0, 1])
def test_all_outcomes_alike(spark, bad):
    df = spark.createDataFrame([(i, f"http://h{i % 3}.net/") for i in range(30)], "page_id long, url string")
    got = url_filter.judge(df, spark.createDataFrame([(i, bad) for i in range(30)], "id long, bad int"), []).collect()
    assert {r["verdict"] for r in got} == {"block" if bad else "allow"}


def test_sites_below_a_public_suffix_of_two_labels_are_apart(spark):
    pages = [(i, f"http://bad.co.uk/{i}") for i in range(40)] + [(100 + i, f"http://user{i}.github.io/") for i in range(3)]
    pages += [(200, "http://site1.co.uk/"), (201, "http://www.bad.co.uk:8080/"), (202, "http://shop.com.au/"), (203, "http://10.0.0.1/x"), (204, "http://10.0.0.2/x"), (205, "http://co.uk/")]
    good = [(300 + i, f"http://fine{i}.co.uk/") for i in range(40)]
    df = spark.createDataFrame(pages + good, "page_id long, url string")
    outcomes = [(i, 1) for i in range(40)] + [(p, 0) for p, _ in good] + [(203, 1)]
    got = {r["page_id"]: r for r in url_filter.judge(df, spark.createDataFrame(outcomes, "id long, bad int"), []).collect()}
    assert got[0]["verdict"] == "block" and got[201]["verdict"] == "block"
    assert all(got[k]["verdict"] == "allow" for k in (200, 202, 204, 205, 100, 300))


def test_pages_without_a_host_have_no_reputation(spark):
    pages = [(i, None) for i in range(40)] + [(100 + i, f"http://h{i % 9}.net/") for i in range(90)]
    outcomes = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(90)], "id long, bad int")
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), outcomes, []).collect()}
    assert got[0]["verdict"] == "allow" and got[0]["bad_bound"] <= 0


def test_large_reputation_tables_are_joined_in_salted_parts(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.net/{i}") for i in range(300)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i % 7 < 3)) for i in range(0, 300, 2)], "id long, bad int")
    want = sorted(map(tuple, url_filter.judge(pages, outcomes, []).collect()), key=str)
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, url_filter.judge(pages, outcomes, []).collect()), key=str) == want
