"""Registered corpus queries against their SQL; the pipeline against brute force."""

import glob
import hashlib
import os
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from loadweave.llm import decontamination, oracle, queries
from tests.llm import test_bpe, test_line_dedup, test_quality_rules, test_similar

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = {n.split("_")[0] for n in queries.all_queries()}


def test_one_query_per_operator():
    assert NAMES == {f"op{n}" for n in range(1, 14)} and len(queries.all_queries()) == 13
    assert set(oracle.all_sql()) < set(queries.all_queries())


@pytest.mark.parametrize("name", list(oracle.all_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.all_queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    found = con.execute(oracle.all_sql()[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    expected = [tuple(r[at.index(c)] for c in columns) for r in found.fetchall()]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def expected_ids(docs, benchmark):
    """The pipeline's documents and ids, stage by stage, without Spark."""
    rows = []
    for r in docs:
        n, _, _, _, repeated, _ = test_quality_rules.by_hand(r["text"])
        if n >= 50 and 100 * repeated <= 50 * n:
            rows.append((r["doc_id"], r["text"], r["lang"], r["source"]))
    rows = list(test_line_dedup.by_hand(rows, 5))
    label, _ = test_similar.groups_by_hand([t for _, t in rows])
    first = {}
    for (doc_id, _), at in zip(rows, label, strict=True):
        first[at] = min(first.get(at, doc_id), doc_id)
    rows = [r for r, at in zip(rows, label, strict=True) if first[at] == r[0]]
    phrases = set()
    for i in benchmark:
        words = decontamination.words_of(i["text"])
        phrases |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))} if words else set()
    for doc_id, text in rows:
        while True:
            words = decontamination.words_of(text)
            hit = [False] * len(words)
            for size in {len(p) for p in phrases}:
                for k in range(len(words) - size + 1):
                    if tuple(words[k : k + size]) in phrases:
                        hit[k : k + size] = [True] * size
            if not any(hit):
                break
            text = decontamination._cut(text, decontamination.np.array(hit))
        yield doc_id, test_bpe.LIBRARY.encode_ordinary(text), hashlib.sha256(text.encode()).hexdigest()


def test_pipeline(spark):
    docs = pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()
    benchmark = pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()
    found = {
        r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect()
    }
    # too few labels here for any cutoff: the base rules decide alone
    assert found == {d: (ids, digest) for d, ids, digest in expected_ids(docs, benchmark)}
    assert 0 < len(found) < len(docs)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules",
        "line_dedup",
        "near_duplicates",
        "decontamination",
        "byte_bpe",
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns


def test_pipeline_with_labels_enough_for_a_cutoff(spark, tmp_path):
    # documents that pass the base rules and go by the cutoffs alone, one copy and one leak among the others
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    good = [" ".join(rng.choices(words, k=80)) for _ in range(600)]
    leak = " ".join(f"leak{i}" for i in range(12))
    good[5] += " " + leak
    lines = ["\n".join([f"line {i} of many", *(["the same again"] * 12), " ".join(rng.choices(words, k=60))]) for i in range(8)]
    texts = [*good, *lines, good[7] + " w1"]
    n = len(texts)
    docs = {"doc_id": list(range(n)), "text": texts, "lang": ["en"] * n, "source": [f"s{i % 3}" for i in range(n)]}
    docs["n_chars"] = [len(t) for t in texts]
    tables = {
        "documents": docs,
        "labels": {"doc_id": list(range(600)), "quality": [1] * 600, "toxic": [0] * 600},
        "benchmark": {"item_id": [1], "text": [leak]},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    found = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == set(range(600))
    expected = good[:5] + [good[5].removesuffix(leak)] + good[6:]
    assert found == {i: test_bpe.LIBRARY.encode_ordinary(t) for i, t in enumerate(expected)}
