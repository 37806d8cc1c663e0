"""Wavelet files against plain arrays, and the query against the library's ids."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from conftest import SMALL
from tabwright.llm import queries, wavelet

CONTENT = queries.byte_bpe()
LIBRARY = Tokenizer.from_str(CONTENT)


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 50_000), (511, 2), (513, 70), (5000, 65_536), (20_000, 9)])
def test_matrix_is_the_array(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint16)
    image = wavelet.encode_shard(ids, [n])
    decoded, lengths = wavelet.decode_shard(image)
    assert decoded.tolist() == ids.tolist() and lengths.tolist() == [n]
    matrix, _ = wavelet.open_shard(image)
    for i in random.Random(1).sample(range(n), min(n, 40)):
        assert matrix[i] == ids[i] and matrix.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
    for value in [*ids[:5].tolist(), 0, 3, 65_535]:
        places = np.flatnonzero(ids == value)
        assert matrix.places(value).tolist() == places.tolist() and matrix.rank(value) == len(places)
        if len(places):
            assert matrix.select(value, len(places) - 1) == places[-1]
    with pytest.raises(IndexError):
        matrix[n]
    with pytest.raises(ValueError):
        wavelet.open_shard(b"????" + image[4:])


def expected(docs):
    at, out = 0, []
    for doc_id, text in docs:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op6(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    rows = queries.QUERIES["op6_wavelet"](spark, SMALL).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == expected(docs)


def test_shards_occurrences_and_edge_cases(spark, tmp_path):
    docs = [(5, "b a b"), (-3, None), (2, ""), (9, "long text " * 20_000), (2, ""), (7, "a\tb"), (None, "x")]
    df = spark.createDataFrame([(d, t, 1, "y") for d, t in docs], "doc_id long, text string, task int, number string")
    path = f"{tmp_path}/tokens"
    wavelet.write_tokens(df, CONTENT, path, shard_ids=10, per_task=100)
    shards = wavelet.read_tokens(spark, path)
    rows = wavelet.documents_of(shards).orderBy("start").collect()
    plain = expected(sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == plain
    ends = sorted(r.place for r in wavelet.occurrences(shards, 2).collect())
    assert ends == [s + n - 1 for _, s, n, _ in plain]
    wavelet.write_tokens(df.limit(0), CONTENT, f"{tmp_path}/none")
    assert wavelet.documents_of(wavelet.read_tokens(spark, f"{tmp_path}/none")).count() == 0
