"""SimHash and embedding near-duplicates against brute force."""

import numpy as np
import pytest
import xxhash

from contactgraph.llm import embeddings, fingerprints, simhash
from contactgraph.functions.components import connected_components
from contactgraph.llm.runs import starts_of_runs

DOCS = "doc_id bigint, text string, lang string, id bigint, fp string"


def plain_fingerprint(text, k):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    label = list(range(n))
    for _ in range(n):
        new = [min([label[j] for j in range(n) if linked(i, j)] + [label[i]]) for i in range(n)]
        if new == label:
            break
        label = new
    return label


def make_docs(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary, 120)) for _ in range(12)]
    texts = []
    for b in base:
        words = b.split()
        texts.append(b)
        for n in (1, 2, 4):
            w = list(words)
            for p in rng.choice(len(w), n, replace=False):
                w[p] = "changed"
            texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), None, "", " \t\n", "one", "One", "É é", "é é", "x " * 40_000]
    rows = [(i * 3 + 1, t, "en", 7, "clash") for i, t in enumerate(texts)] + [(None, base[1], None, None, None)]
    rows += rows[:2]
    return spark.createDataFrame(rows, DOCS), rows


@pytest.mark.parametrize("block", [2, 2_048])
def test_simhash_components_match_brute_force(spark, block):
    docs, rows = make_docs(spark)
    found = simhash.near_duplicates(docs, shingle=4, distance=4, block=block).collect()
    fps = [plain_fingerprint(r[1], 4) for r in rows]
    label = components(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    least = {}
    for i, c in enumerate(label):
        if rows[i][0] is not None:
            least[c] = min(least.get(c, 1 << 60), rows[i][0])
    expected = sorted((r[0] or -1, f"{fps[i]:016x}", least[label[i]]) for i, r in enumerate(rows))
    assert sorted((r["id"] or -1, r["fingerprint"], r["component_id"]) for r in found) == expected


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 4])
def test_every_pair_within_the_radius_collides(distance):
    rng = np.random.default_rng(distance)
    masks = simhash.covering_masks(distance)
    assert len(masks) == 2 ** (distance + 1) - 1
    for _ in range(2_000):
        flipped = sum(1 << int(b) for b in rng.choice(64, distance, replace=False))
        assert any(flipped & m == 0 for m in masks)


def test_spanning_links_join_what_pairs_join():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 4)
    values = np.unique(np.concatenate([c ^ (1 << rng.integers(0, 63, 40)) for c in centre]).astype(np.int64))
    left, right = simhash.spanning_links(values, 2)
    assert sum(map(len, left)) == len(values) - 4


def test_components_of_hubs_chains_loops_and_nothing(spark):
    links = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (7, 7), (None, 3), (2, 1)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(200)} | {i: 1000 for i in range(1000, 1061)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_runs():
    assert starts_of_runs([np.array([1, 1, 2, 2]), np.array([0, 0, 0, 1])]).tolist() == [0, 2, 3]
    assert starts_of_runs([np.array([])]).tolist() == []


def vector_table(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    rows = [c + 0.03 * rng.standard_normal(16) for c in centres for _ in range(8)] + list(rng.standard_normal((100, 16)))
    vectors = [[float(x) for x in v] for v in rows]
    vectors += [vectors[0]] * 5 + [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] * 16]
    vectors += [[x * 1e-200 for x in vectors[1]], [1.0, 2.0], [2.0, 4.1]]
    table = [(i, v, i % 3, i) for i, v in enumerate(vectors)] + [(None, vectors[0], 1, 1)]
    return spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, id long"), table


def brute_vectors(table, least=0.95):
    good = {}
    for i, v, *_ in table:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v) / np.abs(v).max()
            good[i] = v / np.linalg.norm(v)
    links = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= least] for i in good}
    label = {i: i for i in good}
    while True:
        new = {i: min([label[j] for j in links[i]] + [label[i]]) for i in good}
        if new == label:
            return {i: len(n) for i, n in links.items()}, label
        label = new


@pytest.mark.parametrize("block", [4, 1_024])
def test_embedding_links_and_components(spark, block):
    df, table = vector_table(spark)
    found = {r["id"]: r for r in embeddings.near_duplicates(df, block=block).collect()}
    degree, label = brute_vectors(table)
    assert len(found) == len(table)
    true = sum(degree.values())
    assert sum(r["n_links"] for r in found.values()) >= 0.9 * true
    for i, r in found.items():
        assert r["n_links"] <= degree.get(i, 0)
        assert r["component_id"] == label.get(i, i)
        assert r["kept"] == (i is None or i == label.get(i, i))


def test_embeddings_of_nothing(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_query_recall(spark):
    folder = "/root/testdata/sf0.01"
    table = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    from contactgraph.llm import queries

    found = {r["vec_id"]: r["n_links"] for r in queries.op3_embedding_near_dedup(spark, folder).collect()}
    degree, _ = brute_vectors(table)
    assert set(found) == {i for i, _ in table}
    assert sum(found.values()) >= 0.9 * sum(degree.values())


def planted(kind, n, width, seed):
    """Vectors of which half have a partner at a cosine just above 0.95."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, width)) if kind == "clustered" else np.zeros((1, width))
    x = centres[rng.integers(0, len(centres), n)] + (0.5 if kind == "clustered" else 1.0) * rng.standard_normal((n, width))
    x = embeddings.unit(x)
    away = rng.standard_normal((n // 2, width))
    away -= (away * x[: n // 2]).sum(axis=1, keepdims=True) * x[: n // 2]
    cosine = rng.uniform(0.951, 0.97, (n // 2, 1))
    y = cosine * x[: n // 2] + np.sqrt(1 - cosine**2) * embeddings.unit(away)
    return np.concatenate([x, y]), [(i, n + i) for i in range(n // 2)]


@pytest.mark.parametrize("kind, width", [("isotropic", 64), ("clustered", 64), ("isotropic", 256)])
def test_planted_pairs_are_found(spark, kind, width):
    vectors, pairs = planted(kind, 4_000, width, seed=width)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = {r["id"]: r for r in embeddings.near_duplicates(df, block=128).collect()}
    hit = sum(found[a]["component_id"] == found[b]["component_id"] for a, b in pairs)
    assert hit >= 0.97 * len(pairs)
    linked = {i for pair in pairs for i in pair}
    near = vectors @ vectors.T >= 0.95 - 1e-6
    assert all(found[i]["n_links"] <= near[i].sum() - 1 for i in range(len(vectors)))
    assert sum(r["n_links"] for i, r in found.items() if i not in linked) == 0


def test_candidates_do_not_grow_with_the_table():
    per_vector = []
    for n in (20_000, 160_000):
        rows = embeddings.unit(np.random.default_rng(n).standard_normal((n, 64)))
        pivots = rows[: embeddings.pivots_for(n)]
        _, codes = embeddings.pivot_keys(pivots, embeddings.NEAREST, embeddings.SHARED)(rows)
        counts = np.unique(codes, return_counts=True)[1]
        per_vector.append((counts * (counts - 1)).sum() / n)
    assert max(per_vector) < 1.4 * min(per_vector) and max(per_vector) < 400


def test_two_vectors_under_one_id_count_as_one(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r["id"], r["component_id"]) for r in embeddings.near_duplicates(df).collect())
    assert found == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def plain_simhash(text):
    words = text.lower().encode().split()
    words = [w.decode() for w in words]
    if not words:
        terms = [""]
    else:
        terms = [" ".join(words[i : i + 2]) for i in range(max(len(words) - 1, 1))]
    votes, total = [0] * 64, 0
    for t in terms:
        w, h = min(len(t), 16), xxhash.xxh64_intdigest(t.encode(), 42)
        total += w
        for b in range(64):
            votes[b] += w * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def test_fingerprints_of_edited_texts(spark):
    import hashlib

    rng = np.random.default_rng(2)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 90, rng.integers(1, 60))) for _ in range(150)]
    texts[3], texts[4], texts[9] = None, "", "é" * 7
    rows = [(i * 2, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    found = {r["id"]: r for r in fingerprints.fingerprint_edited(docs).collect()}
    order = sorted(rows, reverse=True)
    assert len(found) == len(rows)
    for (i, t, _), (_, after, _) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        row = found[i]
        assert row["n_chars"] == len(t)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints = [plain_simhash(x) for x in (t, edited, after)]
        assert [row[c] % (1 << 64) for c in ("fp", "edited_fp", "next_fp")] == prints


def test_next_document_with_ties_nulls_and_nothing(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(5, "b"), (5, "a"), (None, "n"), (2, "c")], schema)
    found = fingerprints.with_next(docs).filter("not donor").collect()
    assert {(r["id"], r["text"]): r["next_text"] for r in found} == {
        (5, "a"): "b", (5, "b"): "c", (2, "c"): "n", (None, "n"): "a"
    }
    only = fingerprints.with_next(spark.createDataFrame([(None, "x")], schema)).collect()
    assert [(r["text"], r["next_text"]) for r in only if not r["donor"]] == [("x", "x")]
    assert fingerprints.fingerprint_edited(spark.createDataFrame([], schema)).count() == 0


def test_search_within_radius(spark):
    rng = np.random.default_rng(4)
    values = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)]
    values += [v ^ sum(1 << int(b) for b in rng.choice(63, n)) for v in values[:30] for n in (1, 2, 3, 4)]
    values = sorted(set(values))
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = fingerprints.within_radius(df.filter("fp % 2 = 0"), df, radius=3, blocks=6).collect()
    pairs = {
        (a, b): bin((a ^ b) & (2**64 - 1)).count("1")
        for a in values for b in values if a % 2 == 0 and bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    }
    assert len(found) == len(pairs)
    assert {(r["query_fp"], r["fp"]): r["distance"] for r in found} == pairs


def test_count_within_counts_rows(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (50, 7), (51, 1 << 40)], "id long, fp long")
    got = {r["id"]: r["n_near"] for r in fingerprints.count_within(df, df["id"] % 50 == 0).collect()}
    assert got == {0: 4, 1: None, 2: None, 50: 3, 51: None}
