"""Secret scans: fixed patterns, and a battery of randomness tests.

A candidate is a run of characters that secrets are written in. Its encoding is
inferred from its alphabet, and its symbols are tested for being drawn at
random: chi-squared for uniformity over the alphabet, the number of runs above
and below the middle of the alphabet, and the serial correlation of neighbours.
Fisher's method joins the three p-values. Random strings spread evenly over
(0, 1) and ordinary ones pile up at 0; how far that pile reaches depends on the
length, so the share of ordinary strings among those above a threshold is
estimated for each encoding and class of lengths over the whole corpus, and the
threshold of each class is the lowest that keeps this share below the rate asked for.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactgraph.llm.text import in_pieces
from contactgraph.session import cut_lineage

#: Patterns, and the group whose length counts, with the least length.
PATTERNS = {
    "assign": (
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.IGNORECASE | re.ASCII,
        ),
        2,
        8,
    ),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: A run of one character class at least 32 long, found without trying shorter runs.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = [*PATTERNS, "random"]

#: Shortest candidate; shorter strings tell too little.
SHORTEST = 20
#: An equals sign only pads: what is before one inside a run is a string of its own,
#: so that a value is told from its name. Of such parts those that are too short go.
_CANDIDATE = re.compile(r"(?=[A-Za-z0-9+/_=-]{%d})[A-Za-z0-9+/_-]+=*" % SHORTEST)
#: Alphabets in the order of their symbols; the first that holds all characters is taken.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_VALUES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
#: Upper ends of the classes of lengths; one more class lies beyond the last.
LENGTHS = [24, 32, 40, 64, 128, 512]
#: Thresholds are multiples of 1 / LEVELS.
LEVELS = 20


def _upper_chi(x: float, df: int) -> float:
    """P(chi-squared with ``df`` degrees > x), by the cube-root normal form."""
    z = ((max(x, 1e-12) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def infer_encoding(token: str) -> str | None:
    """The first alphabet that holds every character, padding at the end aside."""
    used = set(token.rstrip("="))
    return next((name for name, values in _VALUES.items() if used and used <= values.keys()), None)


def candidates(text: str) -> Iterator[re.Match]:
    """Runs of at least ``SHORTEST`` characters, padding included."""
    return (m for m in _CANDIDATE.finditer(text) if m.end() - m.start() >= SHORTEST)


def randomness(token: str) -> tuple[str | None, float]:
    """The inferred encoding and the joint p-value of the three tests; 0 where
    no alphabet fits or too few symbols are left."""
    name = infer_encoding(token)
    body = token.rstrip("=")
    n = len(body)
    if name is None or n < 4:
        return name, 0.0
    size = len(ALPHABETS[name])
    x = np.array([_VALUES[name][c] for c in body], float)

    # short strings cannot fill a large alphabet: symbols are pooled into equal cells
    cells = max(2, min(size, n // 4))
    expected = np.bincount((np.arange(size) * cells) // size, minlength=cells) * (n / size)
    counts = np.bincount((x.astype(int) * cells) // size, minlength=cells)
    uniform = _upper_chi(float(((counts - expected) ** 2 / expected).sum()), cells - 1)

    high = x >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        turns = _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    else:
        turns = 0.0

    y = x - x.mean()
    total = float((y * y).sum())
    serial = 0.0
    if total > 0:
        r = float((y[1:] * y[:-1]).sum()) / total
        serial = _two_sided((r + 1 / n) * math.sqrt(n))

    logs = [-math.log(max(p, 1e-300)) for p in (uniform, turns, serial)]
    s = sum(logs)
    # P(chi-squared with six degrees > 2 s)
    return name, math.exp(-s) * (1 + s + s * s / 2)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns that are long enough, by start, then kind."""
    spans = []
    for kind, (pattern, group, least) in PATTERNS.items():
        for m in (_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                spans.append((kind, m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


_FOUND = (
    "id bigint, base array<struct<kind:string,start:int,end:int>>, "
    "tokens array<struct<encoding:string,class:int,level:int,start:int,end:int>>"
)
_TYPES = [
    pa.int64(),
    pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),
    pa.list_(
        pa.struct(
            [("encoding", pa.string()), ("class", pa.int32()), ("level", pa.int32()),
             ("start", pa.int32()), ("end", pa.int32())]
        )
    ),
]


def _scan(batches):
    for batch in in_pieces(batches):
        bases, tokens = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            bases.append([{"kind": k, "start": i, "end": j} for k, i, j in base_spans(text)])
            found = []
            for m in candidates(text):
                name, p = randomness(m[0])
                if name is not None:
                    length = int(np.searchsorted(LENGTHS, len(m[0])))
                    level = min(int(p * LEVELS), LEVELS - 1)
                    found.append(
                        {"encoding": name, "class": length, "level": level, "start": m.start(), "end": m.end()}
                    )
            tokens.append(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(bases, _TYPES[1]), pa.array(tokens, _TYPES[2])],
            ["id", "base", "tokens"],
        )


def thresholds(tokens: DataFrame, rate: float) -> DataFrame:
    """``(encoding, class, least)``: the lowest level of each class at which the
    estimated share of ordinary strings among those at or above stays within ``rate``.

    The upper half of the levels is taken to hold random strings alone, which
    fill every level alike; what a level holds above that is ordinary. A class
    whose upper half is empty has no threshold. At most one row per encoding
    and class. Levels without strings count too: the lowest that passes may be one.
    """
    held = tokens.groupBy("encoding", "class", "level").agg(F.count("*").alias("n"))
    # one row per level of each encoding and class
    counts = held.groupBy("encoding", "class").agg(
        F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("held")
    ).select(
        "encoding", "class", "held", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
    ).withColumn("n", F.coalesce(F.try_element_at("held", F.col("level")), F.lit(0)))
    whole = Window.partitionBy("encoding", "class")
    above = whole.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    upper = F.sum(F.when(F.col("level") >= LEVELS // 2, F.col("n")).otherwise(0)).over(whole)
    per_level = upper / F.lit(LEVELS - LEVELS // 2)
    seen = F.sum("n").over(above)
    ordinary = F.greatest(seen - per_level * (F.lit(LEVELS) - F.col("level")), F.lit(0.0))
    return (
        counts.withColumns({"upper": upper, "share": ordinary / F.nullif(seen, F.lit(0))})
        .filter((F.col("upper") > 0) & (F.col("share") <= rate))
        .groupBy("encoding", "class")
        .agg(F.min("level").alias("least"))
    )


def scan(
    docs: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, base, spans)`` per row of ``docs``: arrays of ``(kind, start, end)``
    in code points, by start, then kind; ``base`` has the fixed patterns,
    ``spans`` also the strings found random, as kind ``random``.

    Null texts count as empty. Repeated rows come back as often as they came,
    whatever their id. Each text is read once; what is kept of it are its
    candidates, and the thresholds are counts over all of them. Runs jobs when
    called.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    found = cut_lineage(rows.mapInArrow(_scan, _FOUND))
    least = thresholds(found.select(F.explode("tokens").alias("t")).select("t.*"), rate)
    # bounded by the number of encodings and classes
    table = least.agg(
        F.map_from_entries(
            F.collect_list(F.struct(_class_key("encoding", "class").alias("k"), F.col("least").alias("v")))
        ).alias("least")
    )
    passed = F.filter(
        "tokens",
        lambda t: t["level"] >= F.coalesce(F.col("least")[_class_key(t["encoding"], t["class"])], F.lit(LEVELS)),
    )
    extra = F.transform(
        passed, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end"))
    )
    return found.join(F.broadcast(table)).select(
        "id", "base", _by_start(F.concat("base", extra)).alias("spans")
    )


def _class_key(encoding, length) -> Column:
    return F.concat_ws("/", encoding, F.col(length) if isinstance(length, str) else length)


def _by_start(spans: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(len(KINDS))) for x in pair])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"], rank[s["kind"]].alias("rank"), s["end"], s["kind"])
    )
    return F.transform(
        F.array_sort(keyed),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )


def joined(spans: str | Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(docs: DataFrame, rate: float = 0.05, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of :func:`scan` replaced by ``mark`` and
    ``n_chars``, if there is such a column, counted anew.

    Overlapping spans become one mark; null texts stay null. The texts are read
    twice, for the thresholds and to replace, and never shuffled. Runs jobs.
    """
    rows = docs.select(F.lit(None).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    tokens = rows.mapInArrow(_scan, _FOUND).select(F.explode("tokens").alias("t")).select("t.*")
    # at most one row per encoding and class
    least = {(r["encoding"], r["class"]): r["least"] for r in thresholds(tokens, rate).collect()}
    names = docs.columns
    place = names.index(text_col)

    def run(batches):
        for batch in in_pieces(batches):
            texts = [_redacted(t, least, mark) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    done = docs.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.length(text_col).cast("bigint")) if "n_chars" in names else done


def _redacted(text: str | None, least: dict, mark: str) -> str | None:
    if not text:
        return text
    spans = [(i, j) for _, i, j in base_spans(text)]
    for m in candidates(text):
        name, p = randomness(m[0])
        level = min(int(p * LEVELS), LEVELS - 1)
        if name is not None and level >= least.get((name, int(np.searchsorted(LENGTHS, len(m[0])))), LEVELS):
            spans.append(m.span())
    parts, end = [], 0
    for i, j in sorted(spans):
        if i >= end:
            parts += [text[end:i], mark]
        end = max(end, j)
    return "".join([*parts, text[end:]])
