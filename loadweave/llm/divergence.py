"""How far the vocabularies of sources lie apart, from in-mapper stripes.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z in lower case. Each
language keeps the V terms that ``least_docs`` of its documents have. A group (language,
source), and each language as a whole, gives a kept term
p = 1 + floor(10**9 * (count + 1) / (N + V)), N its count of kept terms. The divergence of p
from q is floor((p - q)**2 / q), in whole numbers.

Three passes:

1. Each task folds whole documents into stripes, hash tables of a term's document
   frequency and of its count per source, and spills them when they hold ``_ENTRIES`` entries
   or ``_BYTES`` of text. Spilled stripes are shuffled and sorted by language and term; equal
   keys are merged as they stream by, a bounded batch at a time. Terms of too few
   documents end here. A frequent term arrives once per spill, not once per occurrence.
2. The groups' totals: narrow aggregates of the kept stripes.
3. Each kept stripe gives its divergences directly. For pairs of sources that both
   lack a term the divergence is the same for every such term; V times that is the base of a
   pair, and a stripe only adds where it differs from it, so its work follows the
   sources that have the term. Tasks read the totals of their language from a file: one
   number per source, against a result of one row per pair of sources.

Null language, source and text are empty ones. A document without terms still makes its
group occur. A group without other sources has no pairs; where V is 0 pairs have value 0.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadweave.llm.common import filesystem, fresh_folder
from loadweave.session import pin

LEAST_DOCS = 3
TOP = 200
_ENTRIES = 400_000
_BYTES = 64 << 20
_CHUNK = 1 << 20
_CELLS = 1 << 20
_ROWS_OUT = 100_000
_STRIPE = pa.schema(
    {
        "lang": pa.string(),
        "term": pa.binary(),
        "docs": pa.int64(),
        "sources": pa.list_(pa.string()),
        "counts": pa.list_(pa.int64()),
    }
)
_STRIPE_DDL = "lang string, term binary, docs long, sources array<string>, counts array<long>"
_FOUND = pa.schema(
    {"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()}
)
_FOUND_DDL = "lang string, source string, part string, item string, value long"
# bytes of terms, A-Z in lower case; all others end a term
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


def _chunks(text: bytes):
    """The terms of a text, in lists of bounded size."""
    text = text.translate(_LETTERS)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + _CHUNK)
        end = len(text) if end < 0 else end
        yield text[start:end].split(b" ")
        start = end


def _stripes(docs: dict, counts: dict):
    """The folded tables as record batches, a stripe per language and term."""
    for lang, frequency in docs.items():
        place = {term: i for i, term in enumerate(frequency)}
        sources = [s for at, s in counts if at == lang]
        at, code, n = [], [], []
        for k, source in enumerate(sources):
            found = counts[lang, source]
            at.append(np.fromiter(map(place.__getitem__, found), np.int64, len(found)))
            code.append(np.full(len(found), k))
            n.append(np.fromiter(found.values(), np.int64, len(found)))
        at, code, n = (np.concatenate(x) for x in (at, code, n))
        order = np.argsort(at, kind="stable")
        offsets = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(place)))))
        names = pa.array(sources, pa.string()).take(pa.array(code[order]))
        table = pa.table(
            [
                pa.repeat(pa.scalar(lang, pa.string()), len(place)),
                pa.array(list(frequency), pa.binary()),
                pa.array(np.fromiter(frequency.values(), np.int64, len(place))),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(n[order])),
            ],
            schema=_STRIPE,
        )
        yield from table.to_batches(max_chunksize=10_000)


def _folded(batches):
    docs, counts, entries, held = {}, {}, 0, 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(
            batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True
        ):
            text = text.as_py()
            if not text:
                continue
            frequency = docs.setdefault(lang, Counter())
            found = counts.setdefault((lang, source), Counter())
            before = len(frequency) + len(found)
            distinct = set()
            for words in _chunks(text):
                found.update(words)
                distinct.update(words)
            distinct.discard(b"")
            found.pop(b"", None)
            frequency.update(distinct)
            entries += len(frequency) + len(found) - before
            held += len(text)
            if entries > _ENTRIES or held > _BYTES:
                yield from _stripes(docs, counts)
                docs, counts, entries, held = {}, {}, 0, 0
    yield from _stripes(docs, counts)


def _starts(rows: pa.Table) -> np.ndarray:
    """Indexes of the first rows of equal language and term; rows come sorted by them."""
    changes = np.zeros(len(rows) - 1, bool)
    for name in ("lang", "term"):
        column = rows.column(name).combine_chunks()
        changes |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(changes) + 1))


def _entries_of(rows: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, source and count of every entry of the stripes."""
    sources, counts = (rows.column(c).combine_chunks() for c in ("sources", "counts"))
    many = pc.list_value_length(sources).to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(rows)), many)
    return at, sources.flatten(), counts.flatten().to_numpy(zero_copy_only=False)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of each one's values (rows of values, if they have any)."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return keys[first], np.add.reduceat(values[order], first, axis=0)


def _merged(rows: pa.Table, starts: np.ndarray) -> pa.Table:
    """One stripe for each run of equal keys."""
    run = np.zeros(len(rows), np.int64)
    run[starts[1:]] = 1
    run = np.cumsum(run)
    at, sources, counts = _entries_of(rows)
    coded = sources.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = max(1, len(coded.dictionary))
    keys, n = _summed(run[at] * size + code, counts)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(keys // size, minlength=len(starts)))))
    firsts = rows.take(pa.array(starts))
    offsets = pa.array(offsets, pa.int32())
    docs = np.add.reduceat(rows.column("docs").to_numpy(), starts)
    names = coded.dictionary.take(pa.array(keys % size))
    return pa.table(
        [
            firsts.column("lang"),
            firsts.column("term"),
            pa.array(docs),
            pa.ListArray.from_arrays(offsets, names),
            pa.ListArray.from_arrays(offsets, pa.array(n)),
        ],
        schema=_STRIPE,
    )


def _merging(least_docs: int):
    def run(batches):
        waiting = None  # the last key, merged so far: it may go on in the next batch

        def kept(table):
            yield from table.filter(pc.greater_equal(table.column("docs"), least_docs)).to_batches()

        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch]).cast(_STRIPE)
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            merged = _merged(rows, _starts(rows))
            yield from kept(merged.slice(0, len(merged) - 1))
            waiting = merged.slice(len(merged) - 1)
        if waiting is not None:
            yield from kept(waiting)

    return run


def stripes(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term (UTF-8), docs, sources and counts of the terms of ``least_docs`` documents."""
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])
    return (
        rows.mapInArrow(_folded, _STRIPE_DDL)
        .repartition("lang", "term")
        .sortWithinPartitions("lang", "term")
        .mapInArrow(_merging(least_docs), _STRIPE_DDL)
    )


def _share(count, total):
    """p of counts; exact for totals up to 2**63 / 1000, as digits are divided out one by one."""
    p, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        p = p * 1000 + digits
    return p + 1


def _apart(p, q):
    return (p - q) ** 2 // q


class _Language:
    """The divergences that the stripes of one language add up to, within bounded memory."""

    def __init__(self, lang: str, folder: str, top: int):
        found, path = filesystem(folder)
        groups = pq.read_table(path, filesystem=found, filters=[("lang", "=", lang)]).sort_by("source")
        self.lang, self.top = lang, top
        self.sources = groups.column("source").combine_chunks()
        self.totals = groups.column("n").to_numpy() + groups.column("v").to_numpy()
        self.total = int(groups.column("n").to_numpy().sum()) + int(groups.column("v")[0].as_py())
        self.rows, self.columns = {}, {}
        self.terms, self.waiting = [], 0
        self.least = np.full(len(self.sources), -1)

    def add(self, stripes: pa.Table):
        """Yields what no longer has to be held."""
        size = len(self.sources)
        at, names, counts = _entries_of(stripes)
        code = pc.index_in(names, self.sources).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.searchsorted(at, np.arange(len(stripes) + 1))
        start = 0
        while start < len(stripes):
            # as many stripes as fill the cells, by sources and by entries
            end = min(
                int(np.searchsorted(ends, ends[start] + _CELLS // size, side="right")) - 1,
                start + _CELLS // size,
            )
            end = min(max(end, start + 1), len(stripes))
            part = slice(ends[start], ends[end])
            self._block(at[part] - start, code[part], counts[part], stripes.column("term").slice(start, end - start))
            start = end
            if (len(self.rows) + len(self.columns)) * size > 4 * _CELLS:
                yield from self._pairs()

    def _block(self, at, code, counts, terms):
        size = len(self.sources)
        all_counts = np.zeros((len(terms), size), np.int64)
        all_counts[at, code] = counts
        p = _share(all_counts, self.totals)
        none = _share(np.zeros(size, np.int64), self.totals)
        # pairs whose first source has the term
        own = p[at, code][:, None]
        change = _apart(own, p[at]) - _apart(none[code][:, None], none)
        for k, x in zip(*_summed(code, change), strict=True):
            self.rows[k] = self.rows[k] + x if k in self.rows else x
        # pairs of which only the second one has it
        lacks = all_counts[at] == 0
        change = np.where(lacks, _apart(p[at], own) - _apart(none, none[code][:, None]), 0)
        for k, x in zip(*_summed(code, change), strict=True):
            self.columns[k] = self.columns[k] + x if k in self.columns else x
        # terms that a source has more often than its language
        q = _share(all_counts.sum(axis=1), self.total)[at]
        own = own[:, 0]
        value = _apart(own, q)
        more = (own > q) & (value >= self.least[code])
        self.terms.append(
            pa.table(
                [pa.array(code[more]), pa.array(value[more]), terms.take(pa.array(at[more]))],
                names=["code", "value", "term"],
            )
        )
        self.waiting += int(more.sum())
        if self.waiting > _ROWS_OUT + 2 * self.top * size:
            self._highest()

    def _highest(self) -> pa.Table:
        """The ``top`` terms of each source so far."""
        rows = pa.concat_tables(self.terms)
        rows = rows.sort_by([("code", "ascending"), ("value", "descending"), ("term", "ascending")])
        code = rows.column("code").to_numpy()
        first = np.searchsorted(code, np.arange(len(self.sources) + 1))
        rows = rows.filter(pa.array(np.arange(len(code)) - first[code] < self.top))
        code, value = (rows.column(c).to_numpy() for c in ("code", "value"))
        first = np.searchsorted(code, np.arange(len(self.sources) + 1))
        full = np.flatnonzero(np.diff(first) >= self.top)
        self.least[full] = value[first[full] + self.top - 1]
        self.terms, self.waiting = [rows], len(rows)
        return rows

    def _out(self, code, part: str, items: pa.Array, value):
        for a in range(0, len(code), _ROWS_OUT):
            b = slice(a, a + _ROWS_OUT)
            many = len(code[b])
            yield pa.record_batch(
                [
                    pa.repeat(pa.scalar(self.lang, pa.string()), many),
                    self.sources.take(pa.array(code[b])),
                    pa.repeat(pa.scalar(part, pa.string()), many),
                    items[b],
                    pa.array(value[b]),
                ],
                schema=_FOUND,
            )

    def _pairs(self):
        for held, by_row in ((self.rows, True), (self.columns, False)):
            for k, x in held.items():
                other = np.flatnonzero(x)
                same = np.full(len(other), k)
                a, b = (same, other) if by_row else (other, same)
                yield from self._out(a, "pair", self.sources.take(pa.array(b)), x[other])
        self.rows, self.columns = {}, {}

    def rest(self):
        yield from self._pairs()
        if self.terms:
            rows = self._highest()
            items = rows.column("term").combine_chunks().cast(pa.string())
            yield from self._out(rows.column("code").to_numpy(), "term", items, rows.column("value").to_numpy())


def _diverging(folder: str, top: int):
    def run(batches):
        now = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch]).cast(_STRIPE)
            langs = rows.column("lang").combine_chunks()
            changes = pc.not_equal(langs[1:], langs[:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(changes) + 1).tolist(), len(rows)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                lang = langs[a].as_py()
                if now is None or now.lang != lang:
                    if now is not None:
                        yield from now.rest()
                    now = _Language(lang, folder, top)
                yield from now.add(rows.slice(a, b - a))
        if now is not None:
            yield from now.rest()

    return run


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n (occurrences of kept terms), v (kept terms of the language)."""
    empty, zero = F.lit(""), F.lit(0).cast("long")
    groups = docs.select(
        F.coalesce(F.col("lang").cast("string"), empty).alias("lang"),
        F.coalesce(F.col("source").cast("string"), empty).alias("source"),
    ).distinct()
    entries = kept.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"))))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    return (
        groups.join(totals, ["lang", "source"], "left")
        .join(terms, "lang", "left")
        .select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"))
    )


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank (from 1, by value and item).

    Part ``pair``: the sum over all kept terms of the source's divergence from another
    source, the item. Part ``term``: the ``top`` terms that the source has more often than its
    language, by their divergence from it.
    """
    spark = docs.sparkSession
    kept = pin(stripes(docs, least_docs))
    folder = f"{fresh_folder(spark, 'stripes')}/groups"
    _groups(docs, kept).write.parquet(folder)
    groups = spark.read.schema("lang string, source string, n long, v long").parquet(folder)
    found = pin(kept.sortWithinPartitions("lang").mapInArrow(_diverging(folder, top), _FOUND_DDL))

    none = {"_p": F.expr("if(v = 0, 1L, 1L + 1000000000L div (n + v))")}
    ones = groups.withColumns(none).select("lang", "source", "v", "_p")
    others = groups.withColumns(none).select("lang", F.col("source").alias("item"), F.col("_p").alias("_q"))
    # one row per pair of sources: that many the result has
    base = ones.join(others, "lang").filter("source != item")
    added = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("added"))
    pairs = base.join(added, ["lang", "source", "item"], "left").select(
        "lang",
        "source",
        F.lit("pair").alias("part"),
        "item",
        F.expr("if(v = 0, 0L, v * (((_p - _q) * (_p - _q)) div _q) + coalesce(added, 0L))").alias("value"),
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(found.filter("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
