"""Small networks and brute-force answers."""

import math
import random
from contextlib import contextmanager

from contactgraph.schema import EDGES, VERTICES, Network, canonical_edges


def make(spark, vertices, edges, partitions=3):
    v = spark.createDataFrame([(i, float(s), h) for i, s, h in vertices], VERTICES)
    e = spark.createDataFrame(list(edges), EDGES)
    return Network(v.repartition(partitions), canonical_edges(e))


def random_network(seed, n=40, m=60, recovered=0.2, offset=0):
    rng = random.Random(seed)
    ids = [offset + 3 * k for k in range(n)]
    vertices = []
    for i in ids:
        status = -1 if rng.random() < recovered else rng.choice([0, 0, 1])
        vertices.append((i, {1: 1.0, -1: 0.0}.get(status, rng.random()), status))
    edges = {tuple(sorted(rng.sample(ids, 2))) for _ in range(m)}
    return vertices, sorted(edges)


def brute_walk(vertices, edges, alpha, steps, scope="both"):
    """Dense walk straight from the definition, artificial edges written out."""
    score = {i: s for i, s, h in vertices if h != -1}
    ids = sorted(score)
    near = {i: {i} for i in ids}
    touched = set()
    for a, b in edges:
        if a in score and b in score:
            near[a].add(b)
            near[b].add(a)
            touched |= {a, b}
        elif scope == "either":
            touched |= {a, b}
    for i in ids:
        if i not in touched:
            near[i] = set(ids)
    weight = {i: math.exp(alpha * score[i]) for i in ids}
    rank = {i: 1 / len(ids) for i in ids}
    for _ in range(steps):
        new = dict.fromkeys(ids, 0.0)
        for i in ids:
            total = sum(weight[j] for j in near[i])
            for j in near[i]:
                new[j] += rank[i] * weight[j] / total
        rank = new
    return rank


def plan_lines(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


@contextmanager
def low_skew_limits(spark):
    """Let adaptive execution treat small partitions as large ones."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
