"""The URL filter against a plain version, and its edges."""

import random
import re

import duckdb
import pytest

from contactgraph.llm import oracles, queries, url_filter
from contactgraph.llm.url_filter import ALLOW, BLOCK, LIMIT, RULES, VOCABULARY, Rule, RuleBook, Terms

PAGES = "page_id bigint, url string, html string, host string, verdict string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, None, "clash", "clash") for i, u in rows], PAGES)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(url, rules=RULES, vocabulary=VOCABULARY, limit=LIMIT):
    """By regular expressions, term by term and rule by rule."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (ascii_lower(m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    text = ascii_lower(url or "")
    hits = {t: len(re.findall(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", text)) for t in vocabulary}
    weight = sum(vocabulary[t] for t, n in hits.items() if n)
    strict = sum(n for t, n in hits.items() if vocabulary[t] >= limit)
    soft = [n for t, n in hits.items() if n and vocabulary[t] < limit]
    verdict = rule.verdict if rule else BLOCK if weight >= limit else ALLOW
    return host, path, rule and rule.host + rule.path, verdict, strict, sum(soft), len(soft), weight


EDGES = [
    None,
    "",
    "casino",
    "https://casino",
    "http://org",
    "http://ORG/",
    "http://example.org?/es/",
    "http://a.Example.ORG/es/1#x://casino",
    "http://example.org/en/1",
    "http://notexample.org/es/x",
    "http://a.com/fr/casino",
    "http://a.com/de/page",
    "http://a.com:8080/de/",
    "x://y://casino.com/de/",
    "http://casinos-casino-CASINO.net/",
    "http://bestcasino.net/mycasino/casino7",
    "http://free-free-free.net/free",
    "http://free-bets.net",
    "http://freebets.net",
    "http://écasino.net/casinoé",
    "http://a_casino_b.net",
    "http://a.net/\npoker?free",
    "://",
    "http://.org/..",
    "http://net/" + "free/" * 100_000 + "bets",
]


def found(df):
    return [(r["id"], *r[1:]) for r in df.collect()]


def test_urls_match_the_plain_version(spark):
    rng = random.Random(1)
    pieces = [
        "http", "://", "/", "?", "#", ".", "-", "_", "org", "com", "example.org", "EXAMPLE", "net", "/es/", "/en/1", "/fr/",
        "/de/", *VOCABULARY, "Casino", "Free", "9", "é", " ", "\n",
    ]
    urls = EDGES + ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(3_000)]
    urls += ["http://" + "".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(3_000)]
    rows = [*enumerate(urls), (None, EDGES[7]), (None, EDGES[7]), (3, EDGES[3])]
    result = found(url_filter.judge(pages_of(spark, rows)))
    assert sorted(result, key=str) == sorted([(i, *plain(u)) for i, u in rows], key=str)
    assert {r[4] for r in result} == {ALLOW, BLOCK}


def test_verdicts_of_the_edges(spark):
    told = {u: r for u, r in zip(EDGES, found(url_filter.judge(pages_of(spark, list(enumerate(EDGES))))))}
    assert told[None][1:5] == ("", "", None, ALLOW)
    assert told["casino"][1:5] == ("", "", None, BLOCK)
    assert told["http://org"][3:5] == (None, ALLOW)  # its path is empty
    assert told["http://ORG/"][3:5] == ("org/", ALLOW)
    assert told["http://a.Example.ORG/es/1#x://casino"][1:5] == ("a.example.org", "/es/1", "example.org/es/", BLOCK)
    assert told["http://notexample.org/es/x"][3:5] == ("org/", ALLOW)
    assert told["http://a.com/fr/casino"][3:6] == ("com/fr/", ALLOW, 1)
    assert told["http://free-free-free.net/free"][4:] == (ALLOW, 0, 4, 1, 1)  # one soft term, however often
    assert told["http://free-bets.net"][4:] == (BLOCK, 0, 2, 2, 4)
    assert told["http://freebets.net"][4] == ALLOW
    assert told["http://bestcasino.net/mycasino/casino7"][4] == ALLOW
    assert told[EDGES[-1]][4] == BLOCK  # the whole url is read


def test_empty_table_empty_vocabulary_and_no_rules(spark):
    assert url_filter.judge(pages_of(spark, [])).collect() == []
    rows = found(url_filter.judge(pages_of(spark, [(1, "http://casino.org/es/")]), rules=(), vocabulary={}))
    assert rows == [(1, "casino.org", "/es/", None, ALLOW, 0, 0, 0, 0)]


def test_longest_rule_wins_and_bad_parameters_are_told():
    book = RuleBook([Rule("b.a", "/", BLOCK), Rule("a", "/xyz", ALLOW), Rule("a", "/x", BLOCK), Rule("C.b.a", "", ALLOW)])
    assert book.find("b.a", "/xyz").text == "a/xyz"
    assert book.find("b.a", "/xy").text == "b.a/"  # as long as a/x, and the longer host
    assert book.find("d.c.b.a", "/x").text == "c.b.a"
    assert book.find("xb.a", "/y") is None
    assert book.find("", "/xyz") is None
    for rules in ([Rule("a", "/", "maybe")], [Rule("a", "/", ALLOW), Rule("A", "/", BLOCK)]):
        with pytest.raises(ValueError):
            RuleBook(rules)
    for terms in ({"": 1}, {"Casino": 1}, {"casino": 0}):
        with pytest.raises(ValueError):
            Terms(terms, LIMIT)


def test_a_soft_term_alone_never_rejects():
    assert all(w < LIMIT for t, w in VOCABULARY.items() if t in url_filter.SOFT)
    assert all(VOCABULARY[t] >= LIMIT for t in url_filter.STRICT)


def test_sql_and_query_agree(spark, small):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    cursor = con.execute(oracles.oracle_sql()["op11_url_filter"])
    names = [d[0] for d in cursor.description]
    df = queries.op11_url_filter(spark, small)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))
