"""The manifest against a plain one, proofs and tampering, and the edges."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from contactgraph.llm import merkle, oracles, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, id string, tree int"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 0) for r in rows], DOCS)


def plain_leaf(row, more=0):
    i, text, lang, source, n = row
    told = [i, source, lang, n if n is None else n + more, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in told))


def plain_tree(nodes):
    """Levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_steps(levels, place):
    steps = []
    for nodes in levels[:-1]:
        start = place // 2 * 2
        steps.append((place % 2, [h for k, h in enumerate(nodes[start : start + 2]) if start + k != place]))
        place //= 2
    return steps


def plain(rows):
    """Rows ``(id, leaf, subroot, root, proof, folded, verified)``."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = own, plain_tree([plain_leaf(r) for r in own])
    top = plain_tree([trees[lang][1][-1][0] for lang in langs]) if rows else []
    found = []
    for at, lang in enumerate(langs):
        own, levels = trees[lang]
        for place, row in enumerate(own):
            steps = plain_steps(levels, place) + plain_steps(top, at)
            i, _, _, _, n = row
            changed = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
            node = plain_leaf(row, 1) if changed else plain_leaf(row)
            for odd, others in steps:
                node = sha("".join(others + [node] if odd else [node] + others))
            proof = sha("".join(h for _, others in steps for h in others))
            root = top[-1][0]
            found.append((i, plain_leaf(row), levels[-1][0], root, proof, node, node == root))
    return sorted(found, key=str)


def proven(spark, rows, height):
    docs = docs_of(spark, rows)
    cols = {c: F.col(c) for c in FIELDS}
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    again = F.when(tampered, merkle.leaf_digest(*(cols | {"n_chars": F.col("n_chars") + 1}).values()))
    return merkle.prove(docs, merkle.leaf_digest(*cols.values()), again, height=height)


def digests(df):
    found = [
        (r["id"], r["leaf"], r["subroot"], r["root"], sha(bytes(r["proof"]).hex()), r["folded_root"], r["verified"])
        for r in df.collect()
    ]
    return sorted(found, key=str)


def rows_of(sizes):
    """Documents of several languages, with ids out of order."""
    rows = []
    for lang, n in sizes.items():
        rows += [(10_000 * len(rows) + (7 * k) % n if n % 7 else k - 5, f"text {k} é" * (k % 3), lang, None if k % 5 == 0 else "s", k) for k in range(n)]
    return rows


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_all_digests_agree(spark, height):
    for sizes in ({"en": 1}, {"en": 2, None: 1}, {"en": 37, "de": 16, "": 5, None: 9, "é": 1, "Z": 8}):
        rows = rows_of(sizes)
        assert digests(proven(spark, rows, height)) == plain(rows)


def test_nulls_copies_long_texts_and_ties(spark):
    rows = [(None, None, None, None, None), (None, "", None, None, 0), (1, "", "en", "", 0), (1, "", "en", "", 0)]
    rows += [(2, "x" * 1_000_000 + "é", "en", "s", 1_000_001), (2, "other", "en", "s", 5), (-3, "a:b", "en", "1:2", None)]
    rows += [(5, "again", "fr", "s", 5)] * 60 + [(2**62 + 1, "t", "fr", "s", 2**62)]
    result = digests(proven(spark, rows, 3))
    assert result == plain(rows)
    assert sum(r[0] is None for r in result) == 2


def test_proofs_lead_to_the_root_and_tampering_does_not(spark):
    rows = rows_of({"en": 100, "de": 30})
    found = proven(spark, rows, 4).collect()
    assert {r["tree"] for r in found} == {"en", "de"}
    for r in found:
        root = merkle.fold(bytes.fromhex(r["leaf"]), r["sides"], bytes(r["proof"])).hex()
        assert root == r["root"]
        tampered = zlib.crc32(str(r["id"]).encode()) % 7 == 0
        assert r["verified"] == (not tampered) == (r["folded_root"] == r["root"])
    assert 0 < sum(not r["verified"] for r in found) < len(found)


def test_empty_table_and_bad_height(spark):
    assert proven(spark, [], 4).collect() == []
    with pytest.raises(ValueError):
        proven(spark, [], 0)


def test_sql_and_query_agree(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    cursor = con.execute(oracles.oracle_sql()["op13_merkle_manifest"])
    names = [d[0] for d in cursor.description]
    df = queries.op13_merkle_manifest(spark, small)
    assert sorted(df.columns) == sorted(names)
    expected = sorted(cursor.fetchall())
    assert expected and sorted(map(tuple, df.select(*names).collect())) == expected
