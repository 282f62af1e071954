import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm import language, toxicity
from corpusmill.llm.queries import QUERIES
from corpusmill.session import materialize

from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "simhash", "packing"]
    assert all(f"op{n}_" in " ".join(QUERIES) for n in range(1, 11))


@pytest.fixture(autouse=True)
def quick_training(monkeypatch):
    """How well the network learns is tested elsewhere."""
    monkeypatch.setattr(toxicity, "ROUNDS", 2)


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if network.score([r.text])[0] < 0.5]
    model = language.learn(spark.createDataFrame(rows, docs.schema))
    rows = [r for r in rows if not model.judge([r.text or ""])[2][0]]
    least = dict(plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows]))
    rows = [r for r in rows if least[r.doc_id] == r.doc_id]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            want[r.doc_id, at] = (len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()), len(ids))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in got} == want
    held = defaultdict(int)
    for r in got:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048


def test_stages_keep_columns_and_take_odd_tables(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "s", 0), (None, None, "en", "s", 1), (902, "12 34", None, "s", 5)], base.schema)
    clash = {"score": 1.5, "predicted": 7, "rejected": "x", "lang_pred": None, "id": 3, "fp": 4, "_row2": 1}
    for rows in (base.unionAll(odd).unionAll(base.where("doc_id < 5")), base.limit(0)):
        docs = rows
        for name, value in clash.items():
            docs = docs.selectExpr("*", f"{'null' if value is None else repr(value)} as {name}")
        docs = docs.withColumn("lang_pred", docs.lang_pred.cast("string"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = materialize(stage(spark, docs, SF), name)
            assert found.columns == docs.columns and found.subtract(docs).isEmpty()
            docs = found
        ids = [r.doc_id for r in docs.collect()]
        assert len(ids) == len(set(ids)) and not {900, 901, 902} & set(ids)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
