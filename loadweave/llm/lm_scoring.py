"""Language-model scores: an interpolated modified Kneser-Ney bigram model.

Tokens are the words of a text (A-Z in lower case, between ASCII white space) and one
end. Documents whose crc32 of the id (as text; null as empty) is no multiple of ten are
learnt from; all are scored. The model is counted in Spark in three rounds, each a shuffle
of sorted, compressed arrays that tasks have summed up beforehand:

1. words by hash: the vocabulary, in sorted hash arrays, one file per range of hashes;
   a word's number is its place in them;
2. pairs of word numbers, in sorted arrays, one file per part; the part depends on the
   first word and on three bits of the second, so a hot word is spread over eight parts;
3. per word: what follows it (total, and how many pairs occur once, twice, more) and
   how many words it follows, in arrays by word number.

Files go to the shared folder under names of the attempt that wrote them; manifests list those that
count. Scoring tasks map them into memory, so their size does not count against a
task's, and look up the distinct words and pairs of a batch in sorted order. Words are known
by XXH64 alone: among a billion words two share a hash with a chance of 3 %.

Discounts come from counts of counts; where these are too few (a count of zero pairs), the
discount is half a count. Rows are scored one by one; a null text has the end only.
"""

from __future__ import annotations

import zlib
from itertools import chain, groupby
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import filesystem, fresh_folder, local_path

END = b" "  # no word: words have no spaces
TOKENS_AT_ONCE = 1 << 18
COUNTS_AT_ONCE = 1 << 21
PART_TOKENS = 1 << 22
CHUNK_BITS = 16  # word numbers per file of the third round
_CACHED = 1 << 18
_SALT = 8


# ---- arrays in tasks --------------------------------------------------------------


class _Hashes(dict):
    """word: unsigned hash, computed once while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def _packed(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, compressed."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _merged(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    keys = np.concatenate([k for k, _ in blocks])
    counts = np.concatenate([c for _, c in blocks])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _by_part(part: np.ndarray, *columns: np.ndarray):
    """Yield (part, columns) of each part, order within a part kept."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(part[a]), [c[order[a:b]] for c in columns]


def _store(folder: str, name: str, *arrays: np.ndarray) -> str:
    place = f"{folder}/{name}-{uuid4().hex}"
    found, path = filesystem(place)
    found.create_dir(path.rpartition("/")[0], recursive=True)
    with found.open_output_stream(path, compression=None) as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).tobytes())
    return place


def _trained_on(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 != 0


def _token_batches(batches, chosen=None):
    """Yield (rows of the batch, token hashes, start of each text), some texts at a time."""
    hashes = _Hashes()
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        rows, words, sizes, held = [], [], [], 0
        for row, doc_id in enumerate(ids):
            if chosen is None or chosen(doc_id):
                rows.append(row)
                words.append((texts[row].as_py() or "").encode().lower().split())
                words[-1].append(END)
                sizes.append(len(words[-1]))
                held += sizes[-1]
            if rows and (held >= TOKENS_AT_ONCE or row == len(ids) - 1):
                tokens = chain.from_iterable(words)
                found = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, held)
                yield batch, rows, found, np.cumsum([0, *sizes[:-1]])
                rows, words, sizes, held = [], [], [], 0
        if rows:
            tokens = chain.from_iterable(words)
            found = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, held)
            yield batch, rows, found, np.cumsum([0, *sizes[:-1]])


_BLOCKS = "part long, keys binary, counts binary"


def _block(part: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"part": [part], "keys": [_pack_sorted(keys)], "counts": [_packed(counts)]}
    )


def _summed(batches):
    """Merge sorted counts of batches until there are many, so that fewer are shuffled."""
    held, size = [], 0
    for keys, counts in batches:
        held.append((keys, counts))
        size += len(keys)
        if size >= COUNTS_AT_ONCE:
            held = [_merged(held)]
            size = len(held[0][0])
            if size >= COUNTS_AT_ONCE // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield _merged(held)


def _grouped(blocks: DataFrame, parts: int) -> DataFrame:
    return blocks.repartition(parts, "part").sortWithinPartitions("part")


def _parts_of(batches):
    """(part, its rows one after the other) from rows sorted by part."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda row: row["part"])


# ---- the model ----------------------------------------------------------------------


class Model(NamedTuple):
    """Where the files are, and the few numbers that hold for the whole model."""

    vocabulary: list[tuple[str, int]]  # (place, words), by hash range
    pairs: list[tuple[str, int, int]]  # (place, pairs, counts beyond a byte), by part
    chunks: list[str]  # by word number
    tokens: int
    words: int
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    low_total: int  # distinct pairs
    low_kinds: tuple[int, int, int]  # words that follow one, two, more words


def _hash_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of equal width of the upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pair_part(first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    mixed = (first * np.uint64(_SALT) + second % np.uint64(_SALT)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


class _Vocabulary:
    """Numbers and counts of words by their hashes."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files
        self.starts = np.cumsum([0] + [n for _, n in files])
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _mapped(self, part: int):
        if part not in self.open:
            place, n = self.files[part]
            path = local_path(place)
            self.open[part] = (
                np.memmap(path, "<u8", "r", shape=n),
                np.memmap(path, "<u8", "r", offset=8 * n, shape=n),
            )
        return self.open[part]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted hashes."""
        numbers, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        if not len(self.files):
            return numbers, counts
        for part, (at,) in _by_part(_hash_part(hashes, len(self.files)), np.arange(len(hashes))):
            if not self.files[part][1]:
                continue
            keys, found = self._mapped(part)
            place = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
            known = keys[place] == hashes[at]
            numbers[at[known]] = self.starts[part] + place[known]
            counts[at[known]] = found[place[known]]
        return numbers, counts

    def of_tokens(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, which = np.unique(hashes, return_inverse=True)
        numbers, counts = self.look_up(distinct)
        return numbers[which], counts[which]


def _firsts(numbers: np.ndarray, starts: np.ndarray, begin: int) -> np.ndarray:
    """The number before each token; ``begin`` before the first of a text."""
    first = np.concatenate(([begin], numbers[:-1]))
    first[starts] = begin
    return first


def _count_words(docs: DataFrame, folder: str, parts: int):
    def count(batches):
        found = (
            np.unique(hashes, return_counts=True)
            for _, _, hashes, _ in _token_batches(batches, _trained_on)
        )
        for keys, counts in _summed(found):
            for part, (k, c) in _by_part(_hash_part(keys, parts), keys, counts):
                yield _block(part, k, c)

    def write(batches):
        for part, rows in _parts_of(batches):
            keys, counts = _merged(
                [(_unpack_sorted(r["keys"]), _unpacked(r["counts"])) for r in rows]
            )
            yield pa.RecordBatch.from_pydict(
                {
                    "part": [part],
                    "place": [_store(folder, f"words-{part:06d}", keys, counts)],
                    "size": [len(keys)],
                    "tokens": [int(counts.sum())],
                }
            )

    blocks = _grouped(docs.mapInArrow(count, _BLOCKS), parts)
    # one row per file
    rows = blocks.mapInArrow(write, "part long, place string, size long, tokens long").collect()
    files = [("", 0)] * parts
    for r in rows:
        files[r.part] = (r.place, r.size)
    return files, sum(r.tokens for r in rows), sum(r.size for r in rows)


def _count_pairs(docs: DataFrame, folder: str, vocabulary, words: int, parts: int):
    if words >= 1 << 31:
        raise ValueError("word numbers no longer fit in a pair")
    width = np.uint64(words + 1)

    def count(batches):
        known = _Vocabulary(vocabulary)

        def pairs(hashes, starts):
            numbers, _ = known.of_tokens(hashes)
            first = _firsts(numbers, starts, words).astype(np.uint64)
            return np.unique(first * width + numbers.astype(np.uint64), return_counts=True)

        found = (pairs(h, s) for _, _, h, s in _token_batches(batches, _trained_on))
        for keys, counts in _summed(found):
            part = _pair_part(keys // width, keys % width, parts)
            for p, (k, c) in _by_part(part, keys, counts):
                yield _block(p, k, c)

    def write(batches):
        for part, rows in _parts_of(batches):
            keys, counts = _merged(
                [(_unpack_sorted(r["keys"]), _unpacked(r["counts"])) for r in rows]
            )
            large = np.flatnonzero(counts > 255)
            place = _store(
                folder,
                f"pairs-{part:06d}",
                keys,
                large.astype("<u8"),
                counts[large],
                np.minimum(counts, 255).astype("u1"),
            )
            kinds = [int((counts == k).sum()) for k in range(1, 5)]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": [part],
                    "place": [place],
                    "size": [len(keys)],
                    "large": [len(large)],
                    "kinds": [kinds],
                }
            )

    blocks = _grouped(docs.mapInArrow(count, _BLOCKS), parts)
    rows = blocks.mapInArrow(
        write, "part long, place string, size long, large long, kinds array<long>"
    ).collect()
    files = [("", 0, 0)] * parts
    for r in rows:
        files[r.part] = (r.place, r.size, r.large)
    return files, [sum(r.kinds[k] for r in rows) for k in range(4)]


def _read_pairs(place: str, size: int, large: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mapped keys, rows and values of counts beyond a byte, counts up to 255."""
    path = local_path(place)
    return (
        np.memmap(path, "<u8", "r", shape=size),
        np.memmap(path, "<u8", "r", offset=8 * size, shape=large) if large else np.empty(0, "<u8"),
        np.memmap(path, "<u8", "r", offset=8 * (size + large), shape=large)
        if large
        else np.empty(0, "<u8"),
        np.memmap(path, "u1", "r", offset=8 * (size + 2 * large), shape=size),
    )


_COLUMNS = ("total", "once", "twice", "more", "follows")


def _count_contexts(spark, folder: str, pairs, words: int):
    chunks = (words >> CHUNK_BITS) + 1  # the last one has the number of the begin
    width = np.uint64(words + 1)

    def measure(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, at, values, small = _read_pairs(row["place"], row["size"], row["large"])
                counts = small.astype(np.uint64)
                counts[at.astype(np.int64)] = values
                first, second = keys // width, keys % width
                head = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
                stats = [
                    np.add.reduceat(x.astype(np.uint64), head)
                    for x in (counts, counts == 1, counts == 2, counts > 2)
                ]
                contexts = first[head]
                seconds, follows = np.unique(second, return_counts=True)
                for side, ids, columns in (
                    (0, contexts, stats),
                    (1, seconds, [follows.astype(np.uint64)]),
                ):
                    part = (ids >> np.uint64(CHUNK_BITS)).astype(np.int64)
                    for p, (i, *c) in _by_part(part, ids, *columns):
                        yield pa.RecordBatch.from_pydict(
                            {
                                "part": [p],
                                "side": [side],
                                "ids": [_pack_sorted(i)],
                                "columns": [[_packed(x) for x in c]],
                            }
                        )

    def write(batches):
        for part, rows in _parts_of(batches):
            base = part << CHUNK_BITS
            sums = np.zeros((5, min(1 << CHUNK_BITS, words + 1 - base)), "<u8")
            for r in rows:
                at = _unpack_sorted(r["ids"]).astype(np.int64) - base
                for k, column in enumerate(r["columns"]):
                    # ids of one block are distinct
                    sums[4 * r["side"] + k, at] += _unpacked(column)
            follows = sums[4]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": [part],
                    "place": [_store(folder, f"contexts-{part:06d}", sums)],
                    "kinds": [
                        [int((follows == k).sum()) for k in range(1, 5)]
                        + [int((follows > 2).sum()), int(follows.sum())]
                    ],
                }
            )

    # one row per file of pairs
    files = spark.createDataFrame(
        [f for f in pairs if f[1]], "place string, size long, large long"
    )
    measured = files.repartition(max(1, len(pairs))).mapInArrow(
        measure, "part long, side long, ids binary, columns array<binary>"
    )
    rows = (
        _grouped(measured, chunks)
        .mapInArrow(write, "part long, place string, kinds array<long>")
        .collect()
    )
    places = [""] * chunks
    for r in rows:
        places[r.part] = r.place
    return places, [sum(r.kinds[k] for r in rows) for k in range(6)]


def _discounts(kinds: list[int]) -> tuple[float, float, float]:
    """Of counts one, two and more, from the numbers of counts one to four."""
    n1, n2, n3, n4 = kinds[:4]
    if not all((n1, n2, n3, n4)):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))


def train(docs: DataFrame) -> Model:
    """Count the model over the training documents of ``docs``."""
    spark = docs.sparkSession
    folder = fresh_folder(spark, "model")
    texts = docs.select("doc_id", "text")
    word_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocabulary, tokens, words = _count_words(texts, folder, word_parts)
    pairs, kinds = _count_pairs(texts, folder, vocabulary, words, tokens // PART_TOKENS + 8)
    chunks, low = _count_contexts(spark, folder, pairs, words)
    return Model(
        vocabulary,
        pairs,
        chunks,
        tokens,
        words,
        _discounts(kinds),
        _discounts(low),
        low[5],
        (low[0], low[1], low[4]),
    )


class Scorer:
    """Scores tokens in a task from the mapped files."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, _Vocabulary(model.vocabulary)
        self.pairs: dict[int, tuple] = {}
        self.chunks: dict[int, np.ndarray] = {}

    def _pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Counts of pairs of known words."""
        width = np.uint64(self.model.words + 1)
        first, second = first.astype(np.uint64), second.astype(np.uint64)
        keys, which = np.unique(first * width + second, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        part = _pair_part(keys // width, keys % width, len(self.model.pairs))
        for p, (at,) in _by_part(part, np.arange(len(keys))):
            if not self.model.pairs[p][1]:
                continue
            if p not in self.pairs:
                self.pairs[p] = _read_pairs(*self.model.pairs[p])
            sorted_keys, large, values, small = self.pairs[p]
            place = np.minimum(np.searchsorted(sorted_keys, keys[at]), len(sorted_keys) - 1)
            known = sorted_keys[place] == keys[at]
            counts[at[known]] = small[place[known]]
            if len(large):
                row = np.minimum(np.searchsorted(large, place), len(large) - 1)
                beyond = known & (large[row] == place)
                counts[at[beyond]] = values[row[beyond]]
        return counts[which]

    def _contexts(self, numbers: np.ndarray) -> np.ndarray:
        """The five columns of known word numbers."""
        distinct, which = np.unique(numbers, return_inverse=True)
        found = np.zeros((5, len(distinct)), np.float64)
        for c, (at,) in _by_part(distinct >> CHUNK_BITS, np.arange(len(distinct))):
            if not self.model.chunks[c]:
                continue
            if c not in self.chunks:
                size = min(1 << CHUNK_BITS, self.model.words + 1 - (c << CHUNK_BITS))
                path = local_path(self.model.chunks[c])
                self.chunks[c] = np.memmap(path, "<u8", "r", shape=(5, size))
            found[:, at] = self.chunks[c][:, distinct[at] - (c << CHUNK_BITS)]
        return found[:, which]

    @staticmethod
    def _discounted(counts: np.ndarray, discounts) -> np.ndarray:
        taken = np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)]
        return np.maximum(counts - taken, 0.0)

    def probabilities(self, hashes: np.ndarray, starts: np.ndarray):
        """Model probability and training count of each token."""
        m = self.model
        numbers, counts = self.vocabulary.of_tokens(hashes)
        first = _firsts(numbers, starts, m.words)
        # below the pairs: how many words a word follows, and below that all words alike
        low = np.full(len(hashes), 1.0 / (m.words + 1))
        known = numbers >= 0
        if m.low_total:
            rest = sum(d * n for d, n in zip(m.low_discounts, m.low_kinds, strict=True))
            low *= rest / m.low_total
            follows = self._contexts(numbers[known])[4]
            low[known] += self._discounted(follows, m.low_discounts) / m.low_total
        result = low.copy()
        seen = first >= 0
        if m.low_total and seen.any():
            total, once, twice, more, _ = self._contexts(first[seen])
            pair = np.zeros(int(seen.sum()))
            both = known[seen]
            pair[both] = self._pair_counts(first[seen][both], numbers[seen][both])
            d1, d2, d3 = m.discounts
            left = d1 * once + d2 * twice + d3 * more
            used = np.maximum(total, 1)
            result[seen] = np.where(
                total > 0,
                self._discounted(pair, m.discounts) / used + left / used * low[seen],
                low[seen],
            )
        return result, counts


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    ``base_score`` adds a tenth to every training count; ``score`` is the model's. Both
    are base-10 logarithms of the probability of the text with its end.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # names and numbers of files

    def run(batches):
        m = sent.value
        scorer = Scorer(m)
        for batch, rows, hashes, starts in _token_batches(batches):
            p, counts = scorer.probabilities(hashes, starts)
            base = np.log10((counts + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([not _trained_on(i) for i in ids.to_pylist()]),
                    pa.array(np.diff(np.append(starts, len(hashes)))),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(rows), m.tokens)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(np.log10(p), starts)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Per side (held_out) the tokens and 10 to the mean negative logarithm per token."""
    return scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("tokens"),
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
    )
