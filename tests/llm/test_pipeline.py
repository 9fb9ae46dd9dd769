"""The pipeline's stages against what each operator says of its own input."""

import corpus_pipeline
from sparkwell.llm import decontaminate, jaccard, secret_scan

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
    for name in list(kept)[:-1]:
        assert kept[name][1].columns == corpus_pipeline.COLUMNS
    before, after = kept["ngram_jaccard"]
    groups = {r.component_id for r in jaccard.jaccard_groups(before).collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == groups
    before, after = kept["decontamination"]
    clean = {r.doc_id for r in decontaminate.decontaminate(before, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("NOT contaminated").collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == clean
    before, after = kept["secrets"]
    assert after.count() == before.count()
    assert secret_scan.scan_secrets(after).where("n_access + n_hex > 0").isEmpty()
    before, after = kept["packing"]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_run_equals_stages(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_rows_of_run_equal_the_stages_done_plainly(spark):
    """Toxic documents by the scores of operator 6, groups and windows by SQL, secrets and pieces text by text."""
    import zlib

    import duckdb
    import numpy as np
    from tokenizers import Tokenizer

    from sparkwell.llm import queries, secret_scan

    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{DATA}/benchmark.parquet'")
    con.execute(f"create table documents as select * from '{DATA}/documents.parquet'")
    keep = lambda ids: con.execute(f"create or replace table documents as select * from documents where doc_id in ({','.join(map(str, ids)) or 'null'})")
    counts = [con.execute("select count(*) from documents").fetchone()[0]]
    scores = {r.doc_id: r.predicted for r in queries.op6_toxicity(spark, DATA).collect()}
    keep([i for i, p in scores.items() if not p])
    counts.append(con.execute("select count(*) from documents").fetchone()[0])
    keep([i for i, _, c in con.execute(queries.ORACLE_SQL["op8_jaccard"]).fetchall() if i == c])
    counts.append(con.execute("select count(*) from documents").fetchone()[0])
    clean = con.execute(f"select doc_id from ({queries.ORACLE_SQL['op5_decontamination']}) where not contaminated").fetchall()
    keep([i for (i,) in clean])
    counts.append(con.execute("select count(*) from documents").fetchone()[0])
    tool, want = Tokenizer.from_file(queries.tokenizer_file()), []
    for i, text in con.execute("select doc_id, coalesce(text, '') from documents").fetchall():
        ids = np.array(tool.encode(secret_scan.redact(text, secret_scan.all_spans(text)[1]), add_special_tokens=False).ids + [1], "<u4")
        want += [(i, p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0.5 * counts[0]
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 4096 for p in held.values()) and len(held) <= -(-sum(r.length for r in got) // 4096) + 1
