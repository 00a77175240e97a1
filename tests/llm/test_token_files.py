import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loadweave.llm import planes, token_files
from tests import helpers as shared
from tests.llm import edges

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("sizes", [[], [0], [1], [planes.BLOCK], [5, 0, 3 * planes.BLOCK + 7, 1]])
def test_file_round_trip(kind, sizes):
    rng = np.random.default_rng(len(sizes))
    docs = [(None if k == 1 else k, rng.integers(0, 1 << 32, n, dtype=np.uint32)) for k, n in enumerate(sizes)]
    out = io.BytesIO()
    writer = planes.Writer(out, kind)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    reader = planes.Reader(Source(out.getvalue()))
    assert reader.doc_sizes.tolist() == sizes
    whole = np.concatenate([i for _, i in docs]) if docs else np.empty(0, np.uint32)
    for row, pieces in reader.documents():
        ids = np.concatenate([np.empty(0, "<u4"), *pieces])
        assert (ids == docs[row][1]).all() and len(ids) == sizes[row]
        assert reader.doc_null[row] == (docs[row][0] is None)
    for start, count in ((0, 10), (planes.BLOCK - 3, 6), (len(whole) - 1, 5)):
        if start >= 0:
            assert (reader.read(start, count) == whole[start : start + count]).all()


def test_small_ids_take_two_planes():
    out = io.BytesIO()
    writer = planes.Writer(out)
    writer.add(1, np.arange(5000, dtype=np.uint32))
    writer.close()
    assert planes.Reader(Source(out.getvalue())).blocks[0][-2:] == (0, 0)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \t\n\r\v\fé́ͅ'ͅΣ<|>"), max_size=60))
def test_pieces_encode_as_the_whole(text):
    tokens = token_files.Tokens(PATH)
    (ids,) = tokens.encode([text])
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_documents(spark):
    rows = [r for r in edges.TEXTS] + [(40, "<|endoftext|> # a#b #", None, None), (41, "ab" * 40000, None, None)]
    docs = edges.clashing(edges.documents(spark, rows))
    manifest = token_files.write_tokens(docs, PATH)
    found = sorted(token_files.read_documents(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    expected, at = [], 0
    for doc_id, text, *_ in rows:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=repr) == sorted(expected, key=repr)
    for r in found:
        assert r.start == at
        at += r.n_tokens


def test_empty_table(spark):
    assert token_files.read_documents(token_files.write_tokens(edges.empty(spark), PATH)).count() == 0


def test_manifest_is_one_file(spark):
    docs = spark.range(400).selectExpr("id doc_id", "concat('text ', id) text")
    with shared.settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        manifest = token_files.write_tokens(docs, PATH)
    assert manifest.count() > 1
    assert len(manifest.inputFiles()) == 1
    found = token_files.read_documents(manifest).orderBy("start").collect()
    assert [r.doc_id for r in found] == list(range(400))
