import random
from itertools import chain, combinations

from siftwire.llm import url_filter as U

RULES = dict((r, v) for v, r in U.RULES)


def plain(url):
    rest = (url or "").partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for rule in RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/x?y", "https://www.example.com/en/1", "https://m.www.example.com/en/", "http://net/es/",
    "http://x.net/fr", "http://x.net/fr/?a=://b/", "http://xnet/es/", "http://com", "ftp://com/#/x", "a://b://c.com/d", "http://ÄÖ.Com/ß",
    "http://h.org?q=/en/", "://example.com/en/", "http://w.com/" + "p/" * 20_000,
]


def test_rules_equal_brute_force(spark, small):
    pages = spark.createDataFrame([(i if i != 2 else None, u, "x") for i, u in enumerate(URLS)] + [(0, None, "x")], "page_id long, url string, host string")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    out = U.judge_urls(pages, labels).collect()
    assert len(out) == len(URLS) + 1
    for r in out:
        assert (r.host, r.path, r.rule) == plain(r.url)
        assert r.verdict == (RULES[r.rule] if r.rule else "allow")
    table = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule) for r in U.url_digest(table, labels).collect()}
    assert got == {r.page_id: plain(r.url) for r in table.collect()}
    assert U.url_digest(table.limit(0), labels.limit(0)).count() == 0


def test_mined_rules_block(spark):
    rng = random.Random(1)
    pages, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        host = rng.choice(["spam", "news", "shop"])
        lang = rng.choice(["en", "fr"])
        url = f"http://{host}.org/{lang}/{'cheap' if bad else rng.choice(['cheap', 'book'])}/{i}{'?pills=1' if bad else ''}"
        pages.append((i, url))
        if i < 400:
            labels.append((i, 0 if bad else 1))
    labels += [(0, 1), (1, None), (None, 0), (5, 7)]
    pages = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    out = U.judge_urls(pages, labels, min_confidence=0.95).collect()
    assert all((r.verdict == "block") == (r.page_id % 3 == 0) for r in out)
    best = {tuple(r.mined_tokens) for r in out if r.verdict == "block"}
    assert best == {("query:pills",)}
    rows = spark.createDataFrame([(["a", "b"], 1)] * 30 + [(["a"], 0)] * 30 + [(["b"], 0)] * 30, "tokens array<string>, label int")
    mined = U.mine_rules(rows)
    assert [(r["items"], r.confidence) for r in mined.table.collect()] == [(["a", "b"], 1.0)]
    judged = mined.judge(spark.createDataFrame([(["b", "a", "c"],), (["b"],), ([],)], "t array<string>"), "t", "m").collect()
    assert {tuple(r.t): r.m is not None for r in judged} == {("b", "a", "c"): True, ("b",): False, (): False}


def plain_rules(rows, min_rows, min_confidence, min_lift):
    """tokens -> confidence of every rule that no part of its tokens makes as surely, by counting all sets of tokens."""
    share = sum(y for _, y in rows) / len(rows)
    sets = set(chain.from_iterable(combinations(sorted(set(t)), n) for t, _ in rows for n in range(1, len(set(t)) + 1)))
    found = {}
    for s in sets:
        labels = [y for t, y in rows if set(s) <= set(t)]
        sure = sum(labels) / len(labels)
        if sum(labels) >= min_rows and sure >= min_confidence and sure / share >= min_lift:
            found[s] = sure
    return {s: sure for s, sure in found.items() if not any(set(p) < set(s) and found[p] >= sure for p in found)}


def test_rules_equal_brute_force_miner(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        tokens = [t for t in "abcdef" if rng.random() < 0.45]
        if "a" in tokens:
            tokens += ["twin-a"]  # occurs with a, always
        odds = 0.9 if {"a", "b"} <= set(tokens) else 0.7 if "c" in tokens and "d" not in tokens else 0.15
        rows.append((tokens, int(rng.random() < odds)))
    mined = U.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label int"), min_support=0.0, min_rows=5, min_confidence=0.5, min_lift=1.2)
    got = {tuple(r["items"]): r.confidence for r in mined.table.collect()}
    want = plain_rules([([t for t in tokens if t != "twin-a"], y) for tokens, y in rows], 5, 0.5, 1.2)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-12 for s in got) and len(got) > 3
    whole = plain_rules(rows, 5, 0.5, 1.2)
    lists = [list(t) for n in range(4) for t in combinations([*"abcdef", "twin-a"], n)]
    judged = mined.judge(spark.createDataFrame([(t,) for t in lists + lists[:3]], "t array<string>"), "t", "m").collect()
    assert len(judged) == len(lists) + 3
    for r in judged:
        best = max((sure for s, sure in whole.items() if set(s) <= set(r.t)), default=None)
        assert (r.m.confidence if r.m else None) == best or abs(r.m.confidence - best) < 1e-12


def test_a_family_of_tokens_hides_no_other_rule(spark):
    family = [f"path:part{i}" for i in range(14)]
    rows = [(family + [f"path:own{i}"], 1) for i in range(300)] + [(["host:other", f"path:p{i}"], int(i % 10 < 7)) for i in range(100)]
    rows += [(["host:good"], 0)] * 600
    almost = [(family[:i] + family[i + 1 :], 1) for i in range(14)]  # so that the family's tokens differ a little
    for extra in ([], almost):
        mined = U.mine_rules(spark.createDataFrame(rows + extra, "tokens array<string>, label int"))
        rules = {tuple(r["items"]): r.confidence for r in mined.table.collect()}
        assert rules[("host:other",)] == 0.7
        singles = {s for s in rules if s[0].startswith("path:part")}
        assert singles and all(len(s) == 1 and rules[s] == 1.0 for s in singles)
        pages = spark.createDataFrame([([t],) for t in family], "t array<string>")
        assert mined.judge(pages, "t", "m").filter("m.confidence = 1.0").count() == 14
