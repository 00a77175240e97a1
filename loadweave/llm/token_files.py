"""Token ids to binary files and back: sorted documents, one file of planes per task.

Documents are range-partitioned and sorted by id, then tokenized in the task that
writes their file (``planes``) to the shared folder. Files get a new name in every
attempt of a task; the manifest, written when all tasks are done, lists those that
count, so a task that is run again leaves at most a file that nobody reads.

Whole texts are encoded with the tokenizers library. Its rules for these files never
look across ASCII white space, so distinct pieces between it are encoded once and
looked up after that. Where the file's split pattern is known to part letters, digits and
other signs, a new piece is put together from such parts, unless it has an apostrophe or
characters that are not plainly one of these. A null text is empty and gives only the end id. Rows with equal
ids follow each other, null ids come first; an empty table gives no file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadweave.llm import planes
from loadweave.llm.common import filesystem, fresh_folder
from loadweave.session import pin

END_ID = 2
_PIECES = 3 << 19
_PIECE_BYTES = 64
_WORDS_AT_ONCE = 1 << 19
# fixed value: the split pattern under which letters, single digits and runs of other signs are words of
# their own, but for some endings after an apostrophe
_PARTING = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# lower-case letters of Latin scripts and frequent signs: what kind they are is the same in all versions of
# Unicode, none composes with another, and lower case maps one to one
_LATIN = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
_SIGNS = "\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u2026"
_OTHER = re.compile(f"[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f{_SIGNS}]")
_SIGN = re.compile(f"([0-9]|[^{_LATIN}0-9\n]+)")


class Tokens:
    """Encodes texts in a task; remembers pieces, as the bytes of their ids, up to a bound."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        rules = json.loads(self.library.to_str())
        self.lowers = '"Lowercase"' in json.dumps(rules["normalizer"])
        self.parts = self.lowers and json.dumps({"Regex": _PARTING}) in json.dumps(rules["pre_tokenizer"])
        special = self.library.get_added_tokens_decoder().items()
        self.whole = [t.content.lower().encode() for _, t in special]
        # a special token ends what stands before it, so it can part pieces in one call
        self.mark, self.mark_id = next(
            ((t.content, i) for i, t in sorted(special) if t.special and not t.normalized), ("", -1)
        )

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        texts = [p.decode() for p in pieces]
        if not self.mark or any(self.mark in t for t in texts):
            found = self.library.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, np.uint32).tobytes() for e in found]
        # this call keeps no places of tokens in the text
        (joined,) = self.library.encode_batch_fast([self.mark.join(texts)], add_special_tokens=False)
        ids = np.array(joined.ids, np.uint32)
        ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
        starts = [0, *(e + 1 for e in ends[:-1])]
        return [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]

    def _pieces(self, text: str) -> list[bytes]:
        data = text.encode()
        if not self.lowers:
            return data.split()
        # lower case first makes more pieces equal; it could make or break an added token,
        # and change which letters compose with marks, so only plain texts and pieces are changed
        if any(t in data.lower() for t in self.whole):
            return data.split()
        if not _OTHER.search(text):
            return text.lower().encode().split()
        return [p.lower() if p.isascii() else p for p in data.split()]

    def _parted(self, pieces: set[bytes]) -> dict[bytes, list[bytes]]:
        """The pieces that can be cut, with their parts."""
        if not self.parts:
            return {}
        able = [
            p
            for p in pieces
            if not p.isalpha()
            and b"'" not in p
            and p == p.lower()
            and (p.isascii() or not _OTHER.search(t := p.decode()) and t == t.lower())
        ]
        for token in self.whole:
            if token in b"\n".join(able):
                able = [p for p in able if token not in p]
        cut = _SIGN.sub(r" \1 ", b"\n".join(able).decode()).encode().split(b"\n")
        found = zip(able, map(bytes.split, cut), strict=True) if able else ()
        return {p: parts for p, parts in found if len(parts) > 1}

    def learn(self, texts: list[list[bytes]]) -> list[bytes]:
        """Make the pieces of some texts known; the long ones of those that were not."""
        if len(self.known) > _PIECES:
            self.known.clear()
        known = self.known
        new = set(chain.from_iterable(texts)).difference(known)
        # most new pieces are known words with signs around them
        parted = self._parted(new)
        whole = {p for p in new if p not in parted}
        whole.update(p for p in chain.from_iterable(parted.values()) if p not in known)
        whole = list(whole)
        for start in range(0, len(whole), 2000):
            part = whole[start : start + 2000]
            known.update(zip(part, self._encoded(part), strict=True))
        for piece, parts in parted.items():
            known[piece] = b"".join(map(known.__getitem__, parts))
        return [p for p in {*whole, *parted} if len(p) > _PIECE_BYTES]

    def encode(self, texts: list[str | None]):
        """Yield the ids of each text as an array, without an end id."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < _WORDS_AT_ONCE:
                group.append(self._pieces(texts[at] or ""))
                size += len(group[-1])
                at += 1
            long = self.learn(group)
            for words in group:
                yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32)
            for piece in long:
                del self.known[piece]


@lru_cache(maxsize=1)
def tokens_of(path: str) -> Tokens:
    """One ``Tokens`` for all tasks of a worker process."""
    return Tokens(path)


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, kind: str = "byte"
) -> DataFrame:
    """Write the files; the manifest: part, place, docs, ids and the number of ids before."""
    folder = fresh_folder(docs.sparkSession, "tokens")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    # equal ids are told apart by their texts, so that they can be split over tasks
    dealt = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")

    def write(batches):
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        tokens = tokens_of(tokenizer_path)
        part = TaskContext.get().partitionId()
        place = f"{folder}/part-{part:06d}-{uuid4().hex}.planes"
        found, path = filesystem(place)
        found.create_dir(path.rpartition("/")[0], recursive=True)
        with found.open_output_stream(path, compression=None) as out:
            writer = planes.Writer(out, kind)
            for batch in chain([first], batches):
                ids = batch.column("doc_id").to_pylist()
                encoded = tokens.encode(batch.column("text").to_pylist())
                for doc_id, found_ids in zip(ids, encoded, strict=True):
                    writer.add(doc_id, np.append(found_ids, np.uint32(end_id)))
            writer.close()
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "place": [place], "docs": [len(writer.docs)], "ids": [writer.ids]}
        )

    files = dealt.select("doc_id", "text").mapInArrow(
        write, "part long, place string, docs long, ids long"
    )
    # one row per file: a table of one file, not of one for each row
    written = pin(files.repartition(1))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn(
        "before", F.coalesce(F.sum("ids").over(earlier), F.lit(0).cast("long"))
    )


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is over the ids as
    little-endian unsigned 32-bit integers.
    """

    def read(batches):
        for batch in batches:
            for place, before in zip(
                batch.column("place").to_pylist(), batch.column("before").to_pylist(), strict=True
            ):
                found, path = filesystem(place)
                with found.open_input_file(path) as source:
                    reader = planes.Reader(source)
                    sums = np.zeros(len(reader.doc_ids), np.int64)
                    for row, pieces in reader.documents():
                        total = 0
                        for piece in pieces:
                            total = zlib.crc32(piece.tobytes(), total)
                        sums[row] = total
                sizes = reader.doc_sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.doc_ids, pa.int64(), mask=reader.doc_null),
                        pa.array(before + np.cumsum(sizes) - sizes),
                        pa.array(sizes),
                        pa.array(sums),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = max(1, manifest.count())
    return (
        manifest.select("place", "before")
        .repartition(files)
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )
