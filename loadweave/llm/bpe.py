"""Byte-level BPE: encoding by ranks and decoding, as the tiktoken library does it.

The words of the corpus (matches of the split pattern) are counted in Spark; the most
frequent ones are encoded there, by higher-order functions that fold the ranked
merges over the word's bytes with a literal map of ranks. The literal is an array of
small maps, chosen by hash, as one map is searched entry by entry.

Their ids go to all tasks as a dictionary of at most ``DICTIONARY_WORDS`` words of at most
``WORD_BYTES`` bytes, whatever the corpus. Tasks split whole texts, look words up, and
fold the merges of the others themselves, in n log n steps for a word of n bytes, so a
text that is one long word is no trouble. Texts do not leave their task.

A null text is empty: no ids. Rows are handled one by one, in any number and order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from itertools import chain

import pyarrow as pa
import pyarrow.compute
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import let
from loadweave.session import pin

DICTIONARY_WORDS = 1 << 18
WORD_BYTES = 64
_BUCKETS = 1 << 13
_CACHED_WORDS = 1 << 17  # beside the dictionary
_ROWS_AT_ONCE = 256
_NONE = (1 << 31) - 1
# the White_Space code points, as \s means other ones in other libraries
_SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one base64 piece and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def portable(pattern: str) -> str:
    r"""The split pattern with \s and \S spelled out."""
    inside = pattern.replace(r"[^\s", f"[^{_SPACE}")
    return inside.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


# ---- in Spark: words and their merges ---------------------------------------------


def _rank_literal(ranks: dict[bytes, int]) -> Column:
    """Buckets of {piece: rank}; a byte is written as the character of its number."""
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        buckets[(h - (h >> 63 << 64)) % _BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _rank_of(piece: Column, ranks: Column) -> Column:
    return let(
        piece,
        lambda p: F.try_element_at(F.get(ranks, F.pmod(F.xxhash64(p), F.lit(_BUCKETS)).cast("int")), p),
    )


def folded(word: Column, ranks: Column) -> Column:
    """The ids of a word: merge the adjacent pair of lowest rank, leftmost first, while one has a rank."""
    text = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")

    def merge(parts, order):
        at = F.array_position(order, F.array_min(order)).cast("int")
        return F.concat(
            F.slice(parts, F.lit(1), at - 1),
            F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))),
            F.slice(parts, at + 2, F.size(parts)),
        )

    def step(state, _):
        def next_state(order):
            done = F.array_min(order) == _NONE
            return F.struct(
                F.when(done, state["parts"]).otherwise(merge(state["parts"], order)).alias("parts"),
                done.alias("done"),
            )

        pairs = F.transform(
            F.sequence(F.lit(0), F.size(state["parts"]) - 2),
            lambda i: F.coalesce(
                _rank_of(F.concat(F.get(state["parts"], i), F.get(state["parts"], i + 1)), ranks),
                F.lit(_NONE),
            ),
        )
        return F.when(state["done"] | (F.size(state["parts"]) < 2), state).otherwise(
            let(pairs, next_state)
        )

    def merged(t):
        bytes_ = F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
        return F.aggregate(
            F.sequence(F.lit(1), F.length(t)),
            F.struct(bytes_.alias("parts"), F.lit(False).alias("done")),
            step,
            lambda s: F.transform(s["parts"], lambda p: _rank_of(p, ranks)),
        )

    return let(
        text,
        lambda t: let(
            _rank_of(t, ranks),
            lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(merged(t)),
        ),
    )


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(portable(pattern)), F.lit(0))
    return (
        docs.select(F.explode(words).alias("word"))
        .filter(F.octet_length("word") <= WORD_BYTES)
        .groupBy("word")
        .count()
    )


def dictionary(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = DICTIONARY_WORDS
) -> DataFrame:
    """word, ids of the most frequent words, at most ``most``.

    Words are taken by whole powers of two of their counts.
    """
    counts = pin(
        word_counts(docs, pattern).select("word", F.floor(F.log2("count")).cast("int").alias("power"))
    )
    # 64 rows at most
    sizes = dict(counts.groupBy("power").count().collect())
    least, total = 64, 0
    while least > 0 and (total := total + sizes.get(least - 1, 0)) <= most:
        least -= 1
    literal = _rank_literal(ranks)
    return counts.filter(F.col("power") >= least).select("word", folded(F.col("word"), literal).alias("ids"))


# ---- in tasks: texts ----------------------------------------------------------------


def fold(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """``folded`` of one word; a heap of pairs over a linked list of pieces."""
    if (whole := ranks.get(word)) is not None:
        return (whole,)
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here
    begin_before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [
        (rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None
    ]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        # pairs that a merge has changed since are stale
        if not alive[i] or end[i] == n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone] = False
        end[i] = stop
        if stop < n:
            begin_before[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if (before := begin_before[i]) >= 0:
            if (rank := ranks.get(word[before:stop])) is not None:
                heapq.heappush(heap, (rank, before, stop))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return tuple(ids)


class Words(dict):
    """word: ids, from a dictionary; other words are folded and kept while there is room."""

    def __init__(self, known: dict[str, tuple[int, ...]], ranks: dict[bytes, int]):
        super().__init__(known)
        self.known, self.ranks = known, ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = fold(word.encode(), self.ranks)
        if len(word) <= WORD_BYTES:
            if len(self) >= len(self.known) + _CACHED_WORDS:
                self.clear()
                self.update(self.known)
            self[word] = ids
        return ids


class Codec:
    """Encodes and decodes texts in a task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: dict[str, tuple[int, ...]]):
        self.split = regex.compile(portable(pattern)).findall
        self.words = Words(known, ranks)
        self.pieces = dict(zip(ranks.values(), ranks, strict=True))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text or ""))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def encoded(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    ``ids_sha256`` is of the decimal ids joined by spaces, ``decoded_sha256`` of the bytes
    that decoding these ids gives.
    """
    ranks = read_ranks(ranks_path)
    context = docs.sparkSession.sparkContext
    words = dictionary(docs, ranks, pattern).toArrow()
    known = {
        w: tuple(i) for w, i in zip(words["word"].to_pylist(), words["ids"].to_pylist(), strict=True)
    }
    sent = context.broadcast((ranks, known))

    def run(batches):
        codec = Codec(sent.value[0], pattern, sent.value[1])
        decimal = {i: str(i) for i in codec.pieces}
        parts = (
            batch.slice(start, _ROWS_AT_ONCE)
            for batch in batches
            for start in range(0, batch.num_rows, _ROWS_AT_ONCE)
        )
        for batch in parts:
            columns = ([], [], [], [])
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text)
                listed = " ".join(map(decimal.__getitem__, ids)).encode()
                row = (
                    len(ids),
                    hashlib.sha256(listed).hexdigest(),
                    hashlib.sha256(codec.decode(ids)).hexdigest(),
                    pa.array(ids, pa.int32()) if with_ids else None,
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            arrays = [
                batch.column("doc_id"),
                pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.string()),
                pa.array(columns[2], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                sizes = pa.array([0, *columns[0]], pa.int64())
                offsets = pa.compute.cumulative_sum(sizes).cast(pa.int32())
                flat = pa.concat_arrays([pa.array([], pa.int32()), *columns[3]])
                arrays.append(pa.ListArray.from_arrays(offsets, flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}"
    )
