"""URL filter: listed rules first, then a weighted vocabulary.

A rule names a host and the start of a path and holds for that host and its
subdomains; of the rules that fit, the longest decides. A url that no rule fits
is judged by its words: an Aho-Corasick automaton finds all terms of the
vocabulary in one pass over the url, terms that are part of a longer word do not
count, and the weights of the distinct terms found are added up. A strict term
weighs as much as the limit, so one hit rejects; a soft term weighs less, so it
takes several different ones.
"""

from __future__ import annotations

from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgraph.llm.text import in_pieces

ALLOW, BLOCK = "allow", "block"
#: From this weight on a url is rejected; a term of this weight is strict.
LIMIT = 4
#: The vocabulary, in ASCII lower case.
STRICT = ("casino", "casinos", "escort", "escorts", "hentai", "porn", "viagra", "xxx")
SOFT = {
    "adult": 2, "ads": 2, "bet": 3, "bets": 3, "betting": 3, "bonus": 2, "buy": 1, "cheap": 2, "click": 1, "coupon": 2,
    "dating": 2, "deals": 1, "discount": 1, "free": 1, "jackpot": 3, "loan": 2, "loans": 2, "nude": 3, "online": 1,
    "payday": 2, "pharmacy": 2, "pill": 2, "pills": 2, "poker": 3, "promo": 1, "replica": 2, "sex": 3, "slot": 2,
    "slots": 3, "spins": 2, "tracker": 2, "track": 2, "watches": 1, "win": 1, "winner": 1,
}
VOCABULARY = {**dict.fromkeys(STRICT, LIMIT), **SOFT}
#: Rules that fit in a dictionary of a task; more must be split by host first.
MOST_RULES = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)


class Rule(NamedTuple):
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("org", "/", ALLOW),
    Rule("example.org", "/es/", BLOCK),
    Rule("example.org", "/en/1", BLOCK),
    Rule("com", "/fr/", ALLOW),
    Rule("com", "/de/", BLOCK),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A to Z in lower case, and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((p for p in map(rest.find, "?#") if p >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_TO_LOWER), slash + path


class RuleBook:
    """Rules by host, and under a host by the lengths of its paths."""

    def __init__(self, rules: tuple[Rule, ...] | list[Rule]):
        if len(rules) > MOST_RULES:
            raise ValueError(f"at most {MOST_RULES} rules, got {len(rules)}")
        self.paths: dict[str, dict[str, Rule]] = {}
        for rule in map(Rule._make, rules):
            if rule.verdict not in (ALLOW, BLOCK):
                raise ValueError(f"verdict must be {ALLOW!r} or {BLOCK!r}, got {rule.verdict!r}")
            rule = rule._replace(host=rule.host.translate(_TO_LOWER))
            known = self.paths.setdefault(rule.host, {}).setdefault(rule.path, rule)
            if known != rule:
                raise ValueError(f"two verdicts for {rule.text!r}")
        self.lengths = {h: sorted({len(p) for p in paths}, reverse=True) for h, paths in self.paths.items()}

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; of equally long ones that of the longer host."""
        best, start = None, 0
        while host and start >= 0:
            suffix = host[start:]
            for n in self.lengths.get(suffix, ()):
                rule = self.paths[suffix].get(path[:n]) if n <= len(path) else None
                if rule is not None:
                    if best is None or len(rule.text) > len(best.text):
                        best = rule
                    break
            start = host.find(".", start) + 1 or -1
        return best


class Terms:
    """The automaton of a vocabulary."""

    def __init__(self, vocabulary: dict[str, int], limit: int):
        self.limit, self.automaton = limit, ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            if not term or term != term.translate(_TO_LOWER) or weight <= 0:
                raise ValueError(f"not a term in lower case with a positive weight: {term!r}, {weight!r}")
            self.automaton.add_word(term, (term, weight))
        if vocabulary:
            self.automaton.make_automaton()

    def hits(self, url: str | None) -> dict[str, tuple[int, int]]:
        """Weight and number of hits of each term that stands in ``url`` with no
        letter or digit next to it."""
        found: dict[str, tuple[int, int]] = {}
        if not url or not len(self.automaton):
            return found
        text = url.translate(_TO_LOWER)
        for last, (term, weight) in self.automaton.iter(text):
            before, after = last - len(term), last + 1
            if (before < 0 or not text[before].isalnum()) and (after == len(text) or not text[after].isalnum()):
                found[term] = (weight, found.get(term, (0, 0))[1] + 1)
        return found


_OUT = {
    "id": pa.int64(), "host": pa.string(), "path": pa.string(), "rule": pa.string(), "verdict": pa.string(),
    "strict_hits": pa.int64(), "soft_hits": pa.int64(), "soft_terms": pa.int64(), "weight": pa.int64(),
}
_SCHEMA = (
    "id bigint, host string, path string, rule string, verdict string, "
    "strict_hits bigint, soft_hits bigint, soft_terms bigint, weight bigint"
)


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] | list[Rule] = RULES,
    vocabulary: dict[str, int] | None = None,
    limit: int = LIMIT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``(id, host, path, rule, verdict, strict_hits, soft_hits, soft_terms, weight)``
    per row of ``pages``.

    ``verdict`` is that of the rule (its host and path joined), else ``block`` if
    the weights of the distinct terms found reach ``limit``, else ``allow``.
    Hits and weight are counted whether a rule fits or not; ``soft_terms`` counts
    the distinct soft ones. A null, empty or relative url has no host and no
    path, so no rule fits it; terms are looked for in the whole url, however long.
    Repeated rows come back as often as they came, other columns are left behind.
    Nothing is shuffled; rules and vocabulary are parameters of bounded size.
    """
    given = VOCABULARY if vocabulary is None else dict(vocabulary)
    rules = tuple(rules)
    RuleBook(rules), Terms(given, limit)  # faults are told before the job

    def run(batches):
        book, terms = RuleBook(rules), Terms(given, limit)
        for batch in in_pieces(batches):
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = book.find(host, path)
                hits = terms.hits(url).values()
                soft = [n for w, n in hits if w < limit]
                weight = sum(w for w, _ in hits)
                verdict = rule.verdict if rule else BLOCK if weight >= limit else ALLOW
                strict = sum(n for w, n in hits if w >= limit)
                rows.append((host, path, rule and rule.text, verdict, strict, sum(soft), len(soft), weight))
            columns = zip(*rows) if rows else [()] * (len(_OUT) - 1)
            arrays = [pa.array(c, t) for c, t in zip(columns, list(_OUT.values())[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], list(_OUT))

    return pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string")).mapInArrow(run, _SCHEMA)
