"""Pages to WARC records in seekable bundles, and back.

Of pages with equal payloads of ``LEAST_BYTES`` or more, the one with the smallest id
is a response with the payload, the others are revisits that refer to it. Smaller
payloads are always written out. A null html is an empty payload. Rows that repeat
the smallest id are responses too, as is every page without id where no other has one.

Digests decide, on narrow rows; only pages whose payload occurs twice enter the table
of firsts. Each task writes its pages to bundles (``bundles``) in the shared folder,
under names of its attempt; the manifest lists the bundles that count.
"""

from __future__ import annotations

from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.llm import bundles
from loadweave.llm.common import filesystem, fresh_folder
from loadweave.session import pin

LEAST_BYTES = 100
BUNDLE_BYTES = 1 << 30
DATE = "2026-01-01T00:00:00Z"


def planned(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, digest, size, refers_to, revisit and the html of responses."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id",
        "url",
        html.alias("html"),
        F.sha2(html, 256).alias("digest"),
        F.octet_length(html).cast("long").alias("size"),
    )
    firsts = pin(
        rows.filter(F.col("size") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first", F.lit(True).alias("again"))
    )
    revisit = F.coalesce("again", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    # repeated payloads grow with the pages: one plan for all sizes
    return rows.join(firsts.hint("merge"), "digest", "left").select(
        "page_id",
        "url",
        "digest",
        "size",
        F.when(revisit, F.col("first")).alias("refers_to"),
        revisit.alias("revisit"),
        F.when(~revisit, F.col("html")).alias("html"),
    )


def write_bundles(
    pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = DATE
) -> DataFrame:
    """Write the records; the manifest: place, records and bytes of each bundle."""
    folder = fresh_folder(pages.sparkSession, "warc")

    def write(batches):
        part, out, writer, place, done = TaskContext.get().partitionId(), None, None, None, []

        def finish():
            writer.close()
            out.close()
            done.append((place, len(writer.map), writer.written))

        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    place = f"{folder}/part-{part:06d}-{uuid4().hex}.warc.zst"
                    found, path = filesystem(place)
                    found.create_dir(path.rpartition("/")[0], recursive=True)
                    out = found.open_output_stream(path, compression=None)
                    writer = bundles.Writer(out)
                payload = None if row["revisit"] else row["html"].encode()
                writer.add(
                    row["page_id"],
                    bundles.record(
                        row["page_id"],
                        row["url"],
                        date,
                        row["digest"],
                        row["size"],
                        payload,
                        row["refers_to"],
                    ),
                )
                if writer.written >= BUNDLE_BYTES:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if done:
            places, records, sizes = map(list, zip(*done, strict=True))
            yield pa.RecordBatch.from_pydict({"place": places, "records": records, "bytes": sizes})

    return pin(
        planned(pages, least_bytes).mapInArrow(write, "place string, records long, bytes long")
    )


def read_bundles(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records.

    The digest of a response is computed from what was read; a damaged one fails.
    """
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
        ]
    )

    def read(batches):
        for batch in batches:
            for place in batch.column("place").to_pylist():
                found, path = filesystem(place)
                with found.open_input_file(path) as source:
                    rows = []
                    for record in bundles.Reader(source).records():
                        rows.append({k: record[k] for k in schema.names})
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return (
        manifest.select("place")
        .repartition(max(1, manifest.count()))
        .mapInArrow(
            read,
            "page_id long, payload_bytes long, payload_digest string, record_type string, "
            "refers_to long",
        )
    )
