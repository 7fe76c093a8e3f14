"""Packing by power-of-two decomposition.

Every document is cut into pieces whose lengths are powers of two, and each
piece is a sequence of its own: no sequence crosses documents, none is padded,
and training batches take sequences of one length from one bucket.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contactgraph.llm.text import LOWER_ASCII, in_pieces

LIMIT = 4_096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Words at which the younger of the two halves of a worker's memory is full.
REMEMBERED = 500_000
#: Documents encoded together.
TOGETHER = 1_024

_encoders: dict = {}


class WordIds:
    """Ids of white-space separated words as packed unsigned 32-bit little endian.

    The tokenizer never joins across ASCII white space, nor a letter with the
    punctuation behind it, so the ids of a text are those of its words in order
    and the ids of ``word,`` those of ``word`` and ``,``. Words of letters alone
    are one unit each, whose last token bears the mark of a word's end; they are
    encoded in one go and cut there.

    Ids are remembered in two halves. When the younger is full it becomes the
    older and a new one begins; a word of the older half that is met again moves
    to the younger. So frequent words stay and those met once soon go.
    """

    def __init__(self, path: str):
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        whole, *parts = (i.tobytes() for i in self._encode(["ab cd,\tef\n(gh)", "ab", "cd", ",", "ef", "(gh)"]))
        if whole != b"".join(parts):
            raise ValueError(f"{path} does not cut texts at white space and words from punctuation")

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, "<u4") for f in found]

    def _learn_letters(self, words: list[bytes]) -> bool:
        for part in range(0, len(words), 4_096):
            some = words[part : part + 4_096]
            (ids,) = self._encode([b" ".join(some).decode()])
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some) or stops[-1] != len(ids):
                return False
            packed, cuts = ids.tobytes(), [0, *(4 * stops).tolist()]
            self.ids.update((w, packed[i:j]) for w, i, j in zip(some, cuts, cuts[1:]))
        return True

    def learn(self, words: set[bytes]) -> None:
        """See to it that the younger half has all of ``words``."""
        if len(self.ids) > REMEMBERED:
            self.older, self.ids = self.ids, {}
        new = words.difference(self.ids)
        again = {w: self.older[w] for w in new if w in self.older}
        self.ids.update(again)
        new.difference_update(again)
        letters, rest, split = [], [], []
        for word in new:
            if word.isalpha():  # bytes: ASCII letters alone
                letters.append(word)
                continue
            stem = word.rstrip(b".,!?;:#$%&*)")
            if not (stem.isalpha() or stem.decode().isalpha()):
                rest.append(word)
            elif len(stem) == len(word):
                letters.append(word)
            else:
                split.append((word, stem, word[len(stem) :]))
        letters.extend({stem for _, stem, _ in split}.difference(self.ids, new))
        rest.extend({tail for _, _, tail in split}.difference(self.ids, new))
        if letters and not self._learn_letters(letters):
            rest += letters
        self.ids.update(zip(rest, (i.tobytes() for i in self._encode([w.decode() for w in rest]))))
        self.ids.update((w, self.ids[stem] + self.ids[tail]) for w, stem, tail in split)

    def encode(self, texts: list[str | bytes | None]) -> list[bytes]:
        """Packed ids of each text, a string or its UTF-8 form, without special
        tokens; null counts as empty."""
        # the tokenizer lowers case itself, but tells special tokens by theirs
        raw = [t.encode() if isinstance(t, str) else t or b"" for t in texts]
        split = [(t if b"<|" in t else t.translate(LOWER_ASCII)).split() for t in raw]
        self.learn(set().union(*split))
        return [b"".join(map(self.ids.__getitem__, words)) for words in split]


def binary_pieces(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids, longest first."""
    pieces = [(start, limit) for start in range(0, n - n % limit, limit)]
    start, rest = n - n % limit, n % limit
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            pieces.append((start, 1 << bit))
            start += 1 << bit
    return pieces


def pack(
    docs: DataFrame,
    limit: int = LIMIT,
    end_id: int = END_ID,
    tokenizer: str = VOCABULARY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id,
    offset, bucket``.

    ``limit`` is a power of two. A document is the ids of its text and
    ``end_id``, so null and empty texts give one piece of one id. ``bucket`` is
    the binary logarithm of the length. ``sequence_id`` follows from the input
    split and the row, so a task that runs again gives the same. No row is
    shuffled. Repeated rows and null ids are packed like any other row. A tokenizer
    that joins across white space is refused.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError(f"limit must be a power of two, got {limit}")
    last = np.array([end_id], "<u4").tobytes()

    def run(batches):
        path = public_tokenizers.path(tokenizer)
        if path not in _encoders:
            _encoders[path] = WordIds(path)
        encoder = _encoders[path]
        for rows in in_pieces(batches, TOGETHER):
            packed = [p + last for p in encoder.encode(rows.column(1).to_pylist())]
            totals = [len(p) // 4 for p in packed]
            cuts = [binary_pieces(n, limit) for n in totals]
            counts = [len(c) for c in cuts]
            spans = np.array([piece for c in cuts for piece in c], np.int64).reshape(-1, 2)
            ids = [p[4 * i : 4 * (i + n)] for p, c in zip(packed, cuts) for i, n in c]
            owner = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(owner),
                    pa.array(spans[:, 0]),
                    pa.array(spans[:, 1]),
                    pa.array(ids, pa.binary()),
                    pa.array(np.repeat(totals, counts)),
                    pa.array(np.log2(spans[:, 1]).astype(np.int32)),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "bucket"],
            )

    # as bytes, which the words are cut from without decoding
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    pieces = rows.mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, bucket int"
    )
    sequence = {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}
    return pieces.withColumns(sequence).select(
        "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"
    )


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their packed ids in place of the ids."""
    columns = [F.crc32("ids").alias("ids_crc32") if c == "ids" else F.col(c) for c in pieces.columns]
    return pieces.select(*columns)
