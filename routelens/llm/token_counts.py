"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as one symbol a byte (the last one marked as word end). A heap holds every adjacent pair that
the vocabulary can merge, ordered by rank and position; the lowest is popped and merged in a linked list until none
is left. The count is the initial symbols minus the merges; identifiers are never made.

Texts stay in their tasks: no shuffle. Counts of pieces are remembered in each worker up to ``REMEMBERED`` pieces and
forgotten all at once beyond, so memory is bounded however many different words the corpus has. The merge table is
a fixed file (its size does not depend on the data) and is broadcast.

Defined cases: null counts as the empty text (0 bytes, 0 tokens); the vocabulary's special strings inside a text are
one token each, as the tokenizer's default has it; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.llm.tables import bounded_batches, table

REMEMBERED = 300_000
LIMIT = 2048

# fixed values of the public vocabulary file word_bpe_49k.json: its pre-tokenizer pattern
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# fixed values: capital letters whose small letters are younger than Python's tables but known to the library, and these small letters
LATER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, **{c: c + 32 for c in range(0x10D50, 0x10D66)}}
_LATER = re.compile("[\u1C89\uA7CB\uA7DA\uA7DC\U00010D50-\U00010D65]")
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    for k, b in enumerate(b for b in range(256) if not out[b]):
        out[b] = chr(256 + k)
    return out


def load_vocabulary(path: str) -> dict:
    """Merge ranks, word-end mark and special strings of a tokenizer file; only word-end byte-level BPE is understood."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
        raise ValueError(f"{path}: not a byte-pair vocabulary with word ends")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"merges": merges, "end": model["end_of_word_suffix"], "special": sorted(t["content"] for t in spec["added_tokens"])}


class PairMerger(dict):
    """Remembered token counts by piece; a missing piece is merged."""

    def __init__(self, vocabulary: dict, remembered: int = REMEMBERED):
        super().__init__()
        names: dict[str, int] = {}

        def number(symbol: str) -> int:
            return names.setdefault(symbol, len(names))

        chars = byte_symbols()
        self.inner = [number(c) for c in chars]
        self.last = [number(c + vocabulary["end"]) for c in chars]
        self.rank = {(number(a), number(b)): (r, number(a + b)) for r, (a, b) in reversed(list(enumerate(vocabulary["merges"])))}
        self.remembered = remembered
        special = [re.escape(s) for s in vocabulary["special"]]
        self.special = re.compile("|".join(special)) if special else None
        self.pieces = regex.compile(PIECES)
        self.ascii_pieces = re.compile(ASCII_PIECES, re.ASCII)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.remembered:
            self.clear()
        count = self[piece] = self.merge(piece.encode("utf-8"))
        return count

    def merge(self, data: bytes) -> int:
        n = len(data)
        symbol = [self.inner[b] for b in data]
        symbol[-1] = self.last[data[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = []
        for i in range(n - 1):
            pair = (symbol[i], symbol[i + 1])
            if pair in rank:
                heap.append((rank[pair][0], i, pair))
        heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if symbol[i] != pair[0] or j >= n or symbol[j] != pair[1]:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = rank[pair][1], -1
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                pair = (symbol[i], symbol[k])
                if pair in rank:
                    heappush(heap, (rank[pair][0], i, pair))
            h = before[i]
            if h >= 0:
                pair = (symbol[h], symbol[i])
                if pair in rank:
                    heappush(heap, (rank[pair][0], h, pair))
        return n - merges

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, plain = 0, [text]
        if self.special is not None and self.special.search(text):
            plain = self.special.split(text)
            total = len(plain) - 1
        for part in plain:
            if part.isascii():
                found = self.ascii_pieces.findall(part.lower())
            else:
                # lower case by character: a final capital sigma has no form of its own here
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                found = self.pieces.findall((part.translate(LATER) if _LATER.search(part) else part).lower())
            total += sum(map(self.__getitem__, found))
        return total


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; ``path`` is a tokenizer file that the driver can read."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = PairMerger(shared.value)
        for batch in batches:
            counts = [merger.count(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over ``limit`` tokens."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_counts(table(spark, sf_dir, "documents"), vocabulary).withColumn("over_limit", F.col("n_tokens") > limit)
