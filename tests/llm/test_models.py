"""Learned operators: gradients, rules, held-out accuracy; and the pipeline."""

import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_near_duplicates import components, plain_fingerprint
from test_texts import plain_base

import corpus_pipeline
from contactgraph.llm import mixing, packing, quality, queries, toxicity

DOCS = "doc_id bigint, text string, score string, _text string"
BAD = ["zilk", "vorbu", "nasgat"]


def labelled(n=900, seed=0):
    """Toxic texts hold a bad word, at times behind a suffix that is seen once;
    poor texts shout or repeat themselves."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioustrnl", k=rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 160))
        toxic, poor = int(rng.random() < 0.2), int(rng.random() < 0.2)
        if toxic:
            for _ in range(2):
                text[rng.randrange(len(text))] = rng.choice(BAD) + rng.choice(["", ",", "".join(rng.choices("aeiou", k=3))])
        text = [w.upper() + "!!" for w in text] if poor and i % 2 else text[:3] * 20 if poor and not toxic else text
        docs.append((i, " ".join(text)))
        labels.append((i, 1 - int("!!" in docs[-1][1] or len(set(text)) <= 3), toxic))
    return docs, labels


def tables(spark, docs, labels):
    odd = [(5000, None), (5001, ""), (None, "no id"), (5002, "x" * 50_000 + " w" * 50_000), docs[0]]
    rows = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs + odd], DOCS)
    more = [(None, 1, 1), (7000, 1, 0), (3, None, None), (4, 7, 7), labels[1]]
    return rows, spark.createDataFrame(labels + more, "doc_id long, quality int, toxic int"), len(docs) + len(odd)


def accuracy(found, labels, column, held):
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["doc_id"] in labels and r[column] and held(r["doc_id"])]
    assert len(pairs) > 100
    return np.mean([p == y for p, y in pairs])


def test_toxicity_learns_words_and_characters(spark):
    docs, labels = labelled()
    rows, marks, n = tables(spark, docs, labels)
    model = toxicity.fit(rows, marks, steps=150)
    scored = toxicity.score(rows, model)
    assert sorted(scored.columns) == sorted(rows.columns)
    found = scored.withColumn("out", toxicity.held_out()).withColumn("predicted", (F.col("score") >= 0.3).cast("int")).collect()
    assert len(found) == n and all(0 <= r["score"] <= 1 for r in found)
    truth = {i: t for i, _, t in labels}
    assert accuracy(found, truth, "out", lambda i: zlib.crc32(str(i).encode()) % 4 == 2) > 0.9
    empty = {r["doc_id"]: r["score"] for r in found}
    assert empty[5000] == empty[5001] < 0.3


def test_toxicity_without_labels_is_the_prior(spark):
    rows, marks, _ = tables(spark, *labelled(20))
    none = toxicity.fit(rows, marks.limit(0))
    assert all(r["score"] == pytest.approx(0.01) for r in toxicity.score(rows, none).collect())
    assert toxicity.score(rows.limit(0), none).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    docs = [["ab", "cd", "ef", "ab"], ["cd", "gh"]]
    model = toxicity._initial([[w.encode() for w in d] for d in docs * 3], np.array([1, 0] * 3, float), rng)
    for name in ("inputs", "bias", "states", "attention", "output", "offset"):
        setattr(model, name, rng.standard_normal(getattr(model, name).shape))
    gates = np.concatenate([toxicity._pad_gates(), rng.standard_normal((5, 2, 3 * toxicity.UNITS))])
    windows = np.array([[1, 2, 3, 1, 4], [5, 2, 0, 0, 0]])
    slope = np.array([0.7, -1.3])

    def loss():
        return float(toxicity.forward(model, gates, windows) @ slope)

    grads, d_gates = toxicity.backward(model, windows, toxicity.forward(model, gates, windows, keep=True), slope)
    for name in ("states", "attention", "output", "offset"):
        array = getattr(model, name)
        for at in list(np.ndindex(array.shape))[:: max(1, array.size // 12)]:
            old, eps = array[at], 1e-3
            array[at] = old + eps
            up = loss()
            array[at] = old - eps
            down = loss()
            array[at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3), (name, at)
    total = np.zeros_like(gates)
    np.add.at(total, windows.ravel(), d_gates.reshape(-1, *gates.shape[1:]))
    for at in [(1, 0, 3), (2, 1, 20), (4, 0, 12), (3, 1, 0), (5, 1, 17)]:
        old, eps = gates[at], 1e-3
        gates[at] = old + eps
        up = loss()
        gates[at] = old - eps
        down = loss()
        gates[at] = old
        assert total[at] == pytest.approx((up - down) / (2 * eps), abs=2e-3), at


def test_windows_cover_and_overlap():
    for n in (1, 47, 48, 49, 80, 81, 500):
        windows = toxicity.windows_of(np.arange(1, n + 1))
        assert set(windows.ravel()) - {0} == set(range(1, n + 1))
        assert windows.shape[1] == toxicity.WINDOW
        assert all(a[-1] >= b[0] for a, b in zip(windows, windows[1:]))


def test_scores_do_not_depend_on_neighbours_or_memory(monkeypatch):
    docs, labels = labelled(60)
    model = toxicity.train([t for _, t in docs], [t for *_, t in labels], 0.2, steps=5)
    texts = [t for _, t in docs] + [None, ""]
    together = toxicity.Scorer(model).scores(texts)
    monkeypatch.setattr(toxicity, "REMEMBERED", 10)
    monkeypatch.setattr(toxicity, "_GROUP", 3)
    apart = toxicity.Scorer(model).scores(texts)
    assert np.allclose(together, apart, atol=1e-5)


def test_quality_rules(spark):
    docs, labels = labelled(seed=1)
    rows, marks, n = tables(spark, docs, labels)
    ensemble = quality.fit(rows, marks)
    assert ensemble.rules
    scored = quality.score(rows, ensemble)
    assert sorted(scored.columns) == sorted(["doc_id", "text", "_text", "score"])
    assert {r["_text"] for r in scored.select("_text").distinct().collect()} == {"clash"}
    found = scored.withColumn("out", quality.held_out()).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).collect()
    assert len(found) == n and all(0 <= r["score"] <= 1 for r in found)
    truth = {i: q for i, q, _ in labels}
    assert accuracy(found, truth, "out", lambda i: zlib.crc32(str(i).encode()) % 3 == 1) > 0.9
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("alike", [True, False])
def test_quality_keeps_the_ratio_of_labels_when_sampled(spark, alike):
    """Texts that tell nothing: the mean score is near the share of label 1 and not at
    the half of the sample; where texts differ, few labels are overfitted a little."""
    rng = random.Random(6)
    docs = [(i, "one text" if alike else " ".join(rng.choices(["ab", "cde", "Fg", "h1"], k=rng.randint(5, 40)))) for i in range(1500)]
    marks = [(i, int(rng.random() < 0.9)) for i in range(1500)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    ensemble = quality.fit(rows, spark.createDataFrame(marks, "doc_id long, quality int"), sample=80)
    mean = quality.score(rows, ensemble).agg(F.avg("score")).first()[0]
    assert mean == pytest.approx(0.9, abs=0.03 if alike else 0.15)


def test_quality_without_labels_and_without_rows(spark):
    rows, marks, n = tables(spark, *labelled(20))
    none = quality.fit(rows, marks.limit(0))
    assert {r["score"] for r in quality.score(rows, none).collect()} == {0.5}
    assert quality.score(rows.limit(0), none).count() == 0


def test_rules_come_from_every_path():
    tree = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 0 > 0.5)
   If (feature 0 <= 1.5)
    Predict: 1.0
   Else (feature 0 > 1.5)
    Predict: 0.0
"""
    rules = {r.terms for r in quality.rules_of(tree, ["a", "b"])}
    assert rules == {
        (("a", "<=", 0.5),),
        (("a", "<=", 0.5), ("b", "<=", 2.0)),
        (("a", "<=", 0.5), ("b", ">", 2.0)),
        (("a", ">", 0.5),),
        (("a", "<=", 1.5), ("a", ">", 0.5)),
        (("a", ">", 1.5),),
    }


def plain_statistics(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    lines = text.split("\n")
    n = len(text)

    def share(part, whole):
        return part / whole if whole else 0.0

    def having(*kinds):
        return sum(unicodedata.category(c).startswith(kinds) for c in text)

    def mark(c):
        return not unicodedata.category(c).startswith(("L", "N")) and c not in " \t\n\x0b\f\r"

    marks = "".join("x" if mark(c) else " " if c in " \t\n\x0b\f\r" else "." for c in text)
    return {
        "log_chars": math.log1p(n),
        "word_length": share(n - len(words), len(words)),
        "longest_word": math.log1p(max(map(len, words), default=0)),
        "distinct_words": share(len(set(words)), len(words)),
        "distinct_lines": share(len(set(lines)), len(lines)),
        "letters": share(having("L"), n),
        "capitals": share(having("Lu"), n),
        "digits": share(having("N"), n),
        "symbols": share(marks.count("x"), n),
        "symbol_runs": share(len(re.findall("x{2,}", marks)), len(words)),
        "lone_symbols": share(len(re.findall("(?<= )x(?= )", marks)), len(words)),
        "sentences": share(len(re.findall(r"[.!?](?=[\s]|$)", text, re.A)), len(words)),
    }


def test_statistics_against_plain_ones(spark):
    rng = random.Random(8)
    pieces = ["word", "Word", "ÉA", "9", "½", " ", "  ", "\n", "\t", ".", "!", "?", "##", "*", "-", "é", "𝒳"]
    texts = [None, "", " ", "a", ".", "a. b! c?", "\n\n", "x" * 100_000] + ["".join(rng.choices(pieces, k=rng.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "_stat_id long, text string")
    rows, columns = quality.statistics(docs)
    assert rows.columns[:2] == ["_stat_id", "text"] and list(columns) == list(plain_statistics(""))
    for r in rows.collect():
        expected = plain_statistics(texts[r["_stat_id"]])
        for name, column in columns.items():
            assert r[column] == pytest.approx(expected[name], abs=1e-12), (name, texts[r["_stat_id"]])


def test_one_id_of_many_rows_has_one_text_in_the_sample(spark):
    docs, labels = labelled(200, seed=3)
    rows = spark.createDataFrame(docs + [(0, f"text {k}") for k in range(2_000)], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []

    def keep(texts, *rest):
        seen.append(len(texts))
        return toxicity_train(texts, *rest)

    toxicity_train, toxicity.train = toxicity.train, keep
    try:
        toxicity.fit(rows, marks, steps=2)
    finally:
        toxicity.train = toxicity_train
    assert 0 < seen[0] <= 200
    assert quality.fit(rows, marks).rules


def plain_logit(model, gates, window):
    """One window, word by word."""
    units = toxicity.UNITS
    states = np.zeros((len(window), 2 * units))
    for d in range(2):
        h = np.zeros(units)
        for t in range(len(window)) if d == 0 else reversed(range(len(window))):
            x, s = gates[window[t], d], h @ model.states[d]
            z, r = (1 / (1 + np.exp(-(x[a:b] + s[a:b]))) for a, b in ((0, units), (units, 2 * units)))
            new = np.tanh(x[2 * units :] + r * s[2 * units :])
            h = z * h + (1 - z) * new
            states[t, d * units : (d + 1) * units] = h
    e = np.exp([s @ model.attention if w else -np.inf for w, s in zip(window, states)])
    return (e / e.sum()) @ states @ model.output + model.offset[0]


def test_forward_pass_against_a_plain_one():
    docs, labels = labelled(60, seed=4)
    model = toxicity.train([t for _, t in docs], [t for _, _, t in labels], 0.2, steps=5)
    words = sorted({w for _, t in docs for w in toxicity.words_of(t)})
    rows, owners, scale = model.grams_of(words)
    order = np.argsort(owners, kind="stable")
    embedded = model.embed(np.array([model.vocabulary.get(w, 0) for w in words]), rows[order], owners[order], scale)
    gates = np.concatenate([toxicity._pad_gates(), model.gates(embedded)])
    rng = np.random.default_rng(0)
    windows = rng.integers(1, len(gates), (20, toxicity.WINDOW))
    windows[:5, 10:] = 0
    found = toxicity.forward(model, gates, windows)
    assert np.allclose(found, [plain_logit(model, gates, w) for w in windows], atol=1e-4)


def test_toxicity_held_out_on_the_tables(spark):
    folder = "/root/testdata/sf0.1"  # sf0.01 has 37 toxic documents to learn from, too few
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [r for r in queries.op7_toxicity(spark, folder).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    toxic = [r["predicted"] for r in found if truth[r["doc_id"]] == 1]
    others = [r["predicted"] for r in found if truth[r["doc_id"]] == 0]
    assert len(toxic) > 100 and np.mean(toxic) > 0.9 and np.mean(others) < 0.02


@pytest.mark.parametrize("name, label", [("op1_quality_rules", "quality")])
def test_held_out_accuracy_on_the_tables(spark, name, label):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [r for r in queries.queries()[name](spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in found]) > 0.9


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version of its decision, over odd rows too."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sources = docs.select("source").limit(1).first()[0]
    odd = [(90001, None, None, None, None), (90002, "", "en", sources, 0), (None, "no id here", "en", None, 10)]
    odd += [(None, "no id here", "en", None, 10), (90003, 'key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "en", sources, 54)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.limit(1))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(out)
        after = spark.read.parquet(out)
        before = docs.collect()
        rows = after.collect()
        if name != "packing":
            assert after.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            assert {tuple(r) for r in rows} <= {tuple(r) for r in before} and len(rows) >= 0.8 * len(before)
        elif name == "simhash_near_dedup":
            fps = [plain_fingerprint(r["text"], 4) for r in before]
            label = components(len(before), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
            assert len(rows) == len(set(label))
            kept = {r["doc_id"] for r in rows}
            for c in set(label):
                ids = [before[i]["doc_id"] for i in range(len(before)) if label[i] == c and before[i]["doc_id"] is not None]
                assert not ids or min(ids) in kept
        elif name == "secret_scan":
            assert len(rows) == len(before) and not any(plain_base(r["text"] or "") for r in rows)
            assert any("[SECRET]" in (r["text"] or "") for r in rows)
        elif name == "source_mixing":
            copies = mixing.mix(docs).groupBy().agg(F.sum("copies")).first()[0]
            assert len(rows) == copies and {tuple(r) for r in rows} <= {tuple(r) for r in before}
        else:
            assert len({r["sequence_id"] for r in rows}) == len(rows)
            total = sum(len(e) // 4 + 1 for e in packing.WordIds(packing.public_tokenizers.path(packing.VOCABULARY)).encode([r["text"] for r in before]))
            assert sum(r["length"] for r in rows) == total
        docs = after
    assert k == 4


def test_near_copies_under_repeated_ids_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text, "en", "a", 1), (1, text + " x", "en", "a", 2), (1, text + " y", "en", "b", 3), (2, text + " z", "en", "a", 4)]
    rows += [(1, "quite another text", "en", "a", 5), (1, "quite another text", "en", "a", 5), (None, text, "en", "a", 6)]
    rows += [(None, "without id", None, None, None)] * 2 + [(3, None, "en", "a", 0), (4, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert len(kept) == 4
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in kept) == [(0, "witho"), (1, "quite"), (1, "w0 w1"), (3, "")]


def test_pipeline_of_nothing(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.count() == 0
