"""The pipeline, stage by stage and as a whole, against brute force over the smallest tables."""

import hashlib
import re
import struct

import public_tokenizers as P

import corpus_pipeline
from rosterly.llm import byte_bpe, quality_rules
from tests.compare import connect
from tests.llm.test_operators import brute_groups, brute_hits

SF = "/root/testdata/sf0.001"
SECRET = re.compile(r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}|token = \"[0-9a-f]{40}\"|TOKEN = \"[0-9A-F]{40}\"|PASSWORD=[0-9A-F]{18}")


def test_stages_and_run(spark):
    import tiktoken

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    con = connect(SF)
    ids = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE kept").fetchall()}
    stages = [ids]
    stages.append({r[0] for r in brute_groups([(i, docs[i]) for i in sorted(stages[-1])]) if r[3]})
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    stages.append({r[0] for r in brute_hits([(i, docs[i]) for i in sorted(stages[-1])], items, 10) if not r[5]})
    stages.append({i for i in stages[-1] if not SECRET.search(docs[i])})
    source = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frame = source.columns, source
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages):
        frame = stage(spark, frame, SF).cache()
        assert frame.columns == columns, name
        got = frame.collect()
        assert sorted(r.doc_id for r in got) == sorted(want), name
        assert all(r.text == docs[r.doc_id] for r in got)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = set()
    for i in stages[-1]:
        t = enc.encode_ordinary(docs[i])
        rows.add((i, len(t), hashlib.sha256(struct.pack(f"<{len(t)}I", *t)).hexdigest(), hashlib.sha256(docs[i].encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == rows
    assert len(stages[-1]) < len(stages[0]) < len(docs)
