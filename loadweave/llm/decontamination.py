"""Benchmark decontamination: an FM-index per shard of documents.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in
lower case. A test phrase is a window of ``WINDOW`` consecutive words of a
benchmark item; an item of fewer words is one phrase. A document word inside an
occurrence of a phrase is hit; overlapping occurrences merge into one span.

The benchmark is cut into blocks of bounded size, written to the shared folder;
tasks hold one block at a time, so it may be of any size. Documents are taken in
shards of some ``SHARD_WORDS`` words (one longer text is a shard of its own), and no
row leaves its task. Words that no phrase of the block has cannot be hit and end
every match, so the index of a shard holds the stretches between them that are
long enough for a phrase. All phrases are searched backwards at once, occurrences
are located from sampled suffix positions.

Null texts have no words. Items without id make words hit but are not listed.
Rows are handled one by one, so repeated rows and ids give repeated results.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from itertools import chain, repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import filesystem, fresh_folder
from loadweave.llm.fmindex import FMIndex

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 500_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TO_SPACED = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower()
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_SPACED).split()


def _block(items: list[tuple[str | None, list[bytes]]], window: int) -> dict:
    """The distinct phrases of some items, by length, and the items that have them."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, words in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        for i in range(max(1, len(ids) - window + 1)):
            owned = owners.setdefault(tuple(ids[i : i + window]), set())
            if item is not None:
                owned.add(item)
    by_length: dict[int, list] = {}
    for phrase, owned in owners.items():
        by_length.setdefault(len(phrase), []).append((phrase, sorted(owned)))
    return {"vocabulary": vocabulary, "phrases": by_length}


def write_phrases(benchmark: DataFrame, window: int = WINDOW) -> list[str]:
    """Write the phrase blocks of ``item_id``, ``text`` and return their places."""
    folder = fresh_folder(benchmark.sparkSession, "phrases")

    def store(items):
        place = f"{folder}/{uuid4().hex}"
        found, path = filesystem(place)
        found.create_dir(path.rpartition("/")[0], recursive=True)
        with found.open_output_stream(path, compression=None) as out:
            out.write(pickle.dumps(_block(items, window)))
        return pa.RecordBatch.from_pydict({"place": [place]})

    def blocks(batches):
        items, size = [], 0
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words := words_of(text):
                    items.append((item, words))
                    size += len(words)
                if size >= BLOCK_WORDS:
                    yield store(items)
                    items, size = [], 0
        if items:
            yield store(items)

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    # places only: one for every half million benchmark words
    return [r.place for r in rows.mapInArrow(blocks, "place string").collect()]


class _Phrases:
    """Reads the blocks one after the other; a single one stays in memory."""

    def __init__(self, places: list[str]):
        self.places, self.only = places, None

    def __iter__(self):
        for place in self.places:
            if self.only is None or len(self.places) > 1:
                found, path = filesystem(place)
                with found.open_input_stream(path, compression=None) as source:
                    self.only = pickle.loads(source.read())
            yield self.only


def _find(docs: list[list[bytes]], phrases):
    """For a shard of documents: words in each, hit mask over all words, items of each."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    total = int(starts[-1])
    change = np.zeros(total + 1, np.int64)
    items: list[set[str]] = [set() for _ in docs]
    for block in phrases:
        lookup = block["vocabulary"].get
        ids = np.fromiter(map(lookup, chain.from_iterable(docs), repeat(0)), np.int64, total)
        # stretches of known words that do not cross a document's end
        known = ids > 0
        begins = known & ~np.concatenate(([False], known[:-1])) if total else known
        inner = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < total)]
        begins[inner] = known[inner]
        first = np.flatnonzero(begins)
        stretch = np.cumsum(begins) - 1
        length = np.bincount(stretch[known], minlength=len(first))
        keep = np.flatnonzero(known)
        keep = keep[(length >= min(block["phrases"], default=1))[stretch[keep]]] if len(first) else keep
        if not len(keep):
            continue
        gap = np.flatnonzero(begins[keep])
        text = np.insert(ids[keep], gap, 0)
        place = np.insert(keep, gap, -1)
        index = FMIndex(text)
        for size, owned in block["phrases"].items():
            found, low, high = index.search(np.array([p for p, _ in owned], np.int64))
            many = high - low
            phrase = np.repeat(found, many)
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many)
            at = place[index.locate(rows + np.arange(len(rows)))]
            np.add.at(change, at, 1)
            np.add.at(change, at + size, -1)
            doc = np.searchsorted(starts, at, side="right") - 1
            for pair in np.unique(doc * len(owned) + phrase).tolist():
                items[pair // len(owned)].update(owned[pair % len(owned)][1])
    return sizes, np.cumsum(change[:-1]) > 0, items


def _spans(hit: np.ndarray) -> np.ndarray:
    """Start and end of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def _cut(text: str, hit: np.ndarray) -> str:
    """The text without the spans, each from its first word's start to its last's end."""
    words = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    kept, at = [], 0
    for start, end in _spans(hit).tolist():
        kept.append(text[at : words[start][0]])
        at = words[end - 1][1]
    return "".join([*kept, text[at:]])


_LOWER = {c: c + 32 for c in range(65, 91)}


def _shards(batches):
    """Batches cut where ``SHARD_WORDS`` are reached, with the words of each row."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        begin, docs, size = 0, [], 0
        for row, text in enumerate(texts):
            docs.append(words_of(text))
            size += len(docs[-1])
            if size >= SHARD_WORDS:
                yield batch.slice(begin, row + 1 - begin), docs
                begin, docs, size = row + 1, [], 0
        if docs:
            yield batch.slice(begin), docs


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the merged spans.

    ``items_sha256`` is of the ids of items that occur, sorted as strings and
    comma-joined; ``spans`` are start:end in words, end exclusive, comma-joined.
    """
    places = write_phrases(benchmark, window)

    def run(batches):
        phrases = _Phrases(places)
        for batch, words in _shards(batches):
            sizes, hit, items = _find(words, phrases)
            ends = np.cumsum(sizes)
            parts = [hit[e - s : e] for s, e in zip(sizes, ends, strict=True)]
            ids = [",".join(sorted(i)).encode() for i in items]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array([int(p.sum()) for p in parts], pa.int64()),
                    pa.array([len(i) for i in items], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([bool(p.any()) for p in parts]),
                    pa.array([",".join(f"{a}:{b}" for a, b in _spans(p).tolist()) for p in parts]),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, "
        "contaminated boolean, spans string",
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all spans cut from ``text``; other columns and rows stay.

    What stood around a span may form a phrase once they meet; texts are cut again
    until no phrase is left.
    """
    places = write_phrases(benchmark, window)

    def run(batches):
        phrases = _Phrases(places)
        for batch, words in _shards(batches):
            at = batch.schema.get_field_index("text")
            texts = _cleaned(batch.column(at).to_pylist(), words, phrases)
            changed = pa.array(texts, batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), changed)

    return docs.mapInArrow(run, docs.schema)


def _cleaned(texts: list[str | None], words: list[list[bytes]], phrases) -> list[str | None]:
    """The texts of a shard without spans. Those that a round has cut are the shard of the next one."""
    texts, rows = list(texts), list(range(len(texts)))
    while rows:
        sizes, hit, _ = _find(words, phrases)
        parts = np.split(hit, np.cumsum(sizes)[:-1])
        again = []
        for row, part in zip(rows, parts, strict=True):
            if part.any():
                texts[row] = _cut(texts[row], part)
                again.append(row)
        rows, words = again, [words_of(texts[row]) for row in again]
    return texts
