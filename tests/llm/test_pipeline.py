"""The pipeline, stage by stage, on planted cases."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken
from helpers import documents
from test_text_filters import prose

from vspark.llm import bpe


def test_stages(spark, tmp_path):
    rows = [(i, prose(i, 60), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[1][1] + " more", "en", "s1"), (102, None, "en", "s0"), (103, "123 456 !!", "en", "s0"), (104, prose(104, 60) + " mail me@x.example.com now", None, "s1")]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        seen[name] = kept
        assert name == "bpe" or kept.columns == columns
    ids = lambda name: sorted(r.doc_id for r in seen[name].select("doc_id").collect())
    assert ids("language") == [*range(60), 100, 101, 104]
    assert ids("near_dedup") == [*range(60), 104] == ids("pii")
    r = seen["pii"].filter("doc_id = 104").first()
    assert "<EMAIL>" in r.text and r.n_chars == len(r.text) and r.lang == "en"
    mixed = ids("mixing")
    assert set(mixed) <= set(ids("pii")) and max(mixed.count(i) for i in set(mixed)) <= 2 and ids("bpe") == mixed
    with open(P.path(corpus_pipeline.TOKENS), "rb") as f:
        truth = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    texts = {r.doc_id: r.text for r in seen["mixing"].collect()}
    for r in seen["bpe"].collect():
        expected = np.array(truth.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert bytes(r.token_ids) == expected and r.ids_sha256 == hashlib.sha256(expected).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, seen["bpe"].collect()))
