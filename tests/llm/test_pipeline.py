"""The pipeline's run from table to token ids, on empty and null tables and on a small corpus against the library's encoding."""

import hashlib

import public_tokenizers as P
import pytest

from pagelens.llm import op3_bpe
from tests.llm.test_llm import DDL, corpus

pipeline = pytest.importorskip("corpus_pipeline")


def run(spark, folder, rows):
    spark.createDataFrame(rows, DDL).write.parquet(f"{folder}/documents.parquet")
    return pipeline.run(spark, str(folder))


def test_empty_and_null_tables(spark, tmp_path):
    for name, rows in (("empty", []), ("null", [(None, None, None, None, None)] * 3 + [(1, None, None, None, None), (2, "", "en", "s", 0)])):
        out = run(spark, tmp_path / name, rows)
        assert out.columns == ["doc_id", "n_tokens", "token_ids", "decoded_sha256"] and out.count() == 0


def test_what_is_kept_is_encoded_whole(spark, tmp_path):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op3_bpe.load_ranks(path), special_tokens={})
    rows = [(i, t, "en", s, n) for i, t, lang, s, n in corpus() if i is not None and i not in (3,)]
    texts = {i: t for i, t, *_ in rows}
    out = run(spark, tmp_path / "some", rows).collect()
    assert 10 < len(out) < len(rows) and len({r.doc_id for r in out}) == len(out)
    for r in out:
        kept = library.decode_bytes(r.token_ids).decode()
        assert r.decoded_sha256 == hashlib.sha256(kept.encode()).hexdigest() and r.n_tokens == len(r.token_ids)
        assert list(r.token_ids) == library.encode_ordinary(kept)
        rest = iter(texts[r.doc_id].split("\n"))  # lines may have gone, in their order
        assert all(line in rest for line in kept.split("\n"))
    assert sum(library.decode_bytes(r.token_ids).decode() == texts[r.doc_id] for r in out) > len(out) / 3
