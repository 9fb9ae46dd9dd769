"""The registered queries themselves: columns, types and what each must return for the given tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from sparkwell.llm import queries

DATA = "/root/testdata/sf0.001"
TYPES = {
    "op1_near_duplicates": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op2_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op9_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op10_token_counts": {"doc_id": "bigint", "n_tokens": "bigint"},
    "op11_filter_audit": {"part": "string", "filter_order": "string", "step": "int", **{c: "bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}},
    "op12_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op13_fill_in_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
}


@pytest.fixture(scope="module")
def got(spark):
    return {name: (f(spark, DATA), f(spark, DATA).collect()) for name, f in queries.QUERIES.items()}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.mark.parametrize("name", TYPES)
def test_columns_and_types(got, name):
    have = dict(got[name][0].dtypes)
    assert {c: have.get(c) for c in TYPES[name]} == TYPES[name]


@pytest.mark.parametrize("name", [n for n in TYPES if n not in ("op1_near_duplicates", "op7_packing", "op11_filter_audit")])
def test_one_row_for_each_document(got, texts, name):
    assert sorted(r.doc_id for r in got[name][1]) == sorted(texts)


def test_shards(got, texts):
    rows = got["op2_sharding"][1]
    total = sum(len((t or "").encode()) + 8 for t in texts.values())
    most = max(r.size for r in rows)
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None
    for shard in range(24):
        mine = sorted(r.slot for r in rows if r.shard == shard)
        assert mine == list(range(len(mine)))
        assert abs(sum(r.size for r in rows if r.shard == shard) - total / 24) <= most
    # a plain running sum in the order of ids puts every document where the query puts it
    upto = 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        upto += r.size
        assert r.shard == min(23, 24 * (2 * upto - r.size) // (2 * total))


def test_what_is_held_out(got):
    for name, n, k in (("op3_language", 4, 2), ("op4_quality", 3, 1), ("op6_toxicity", 5, 0)):
        for r in got[name][1]:
            assert r.held_out == (crc(r.doc_id) % n == k) and 0 <= r.score <= 1
            assert name == "op3_language" or r.predicted == (r.score >= 0.5)


def test_pieces(got, texts):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.tokenizer_file())
    want, places = [], {}
    for i, t in texts.items():
        ids = np.array(tool.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    rows = got["op7_packing"][1]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        upto = 0
        for offset, length in sorted(p):
            assert offset == upto
            upto += length
        assert upto <= 4096
    assert len(places) <= 1.02 * sum(r.length for r in rows) / 4096 + 1


def test_base_secrets_equal_plain_patterns(got, texts):
    kinds = {
        "assign": (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    for r in got["op9_secrets"][1]:
        found = [(m.start(), list(kinds).index(k), m.end(), k) for k, (pattern, ok) in kinds.items() for m in pattern.finditer(texts[r.doc_id] or "") if ok(m)]
        spelled = [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x[3] for x in found) for k in kinds)
        assert r.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert set(spelled) <= set(r.spans.split(",")) or not spelled


def planted(spark, tmp_path):
    """The given vectors, and beside every third one scaled, nearly equal, or moved too far; some under another label."""
    rng = np.random.default_rng(7)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    for k, (i, v, label) in enumerate(rows[::3]):
        v = np.array(v)
        near = v + rng.standard_normal(len(v)) * np.linalg.norm(v) / np.sqrt(len(v)) * (0.0, 0.1, 0.17, 0.3)[k % 4]
        rows.append((100_000 + i, (near * (1 + k % 3)).tolist(), label if k % 7 else (label + 1) % 10))
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return rows


def test_near_duplicates(spark, tmp_path):
    rows = planted(spark, tmp_path)
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([x for _, _, x in rows])
    close = (unit @ unit.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(close, False)
    assert 150 < close.sum() < 1000
    got = {r.vec_id: r for r in queries.op1_near_duplicates(spark, str(tmp_path)).collect()}
    want = dict(zip((i for i, _, _ in rows), close.sum(1).tolist(), strict=True))
    asked = [i for i in want if i % 20 == 0]
    assert sum(got[i].n_links for i in asked) >= 0.9 * sum(want[i] for i in asked) and sum(r.n_links for r in got.values()) >= 0.9 * close.sum()
    assert all(got[i].n_links <= n for i, n in want.items())
    for x, (i, _, _) in enumerate(rows):
        joined = {rows[j][0] for j in np.flatnonzero(close[x])} | {i}
        assert got[i].component_id in (i, min(joined)) or got[i].component_id < i and got[i].n_links
        assert got[i].kept == (got[i].component_id == i)


def test_byte_bpe_equals_the_library(got, texts):
    import public_tokenizers
    from sparkwell.llm.byte_bpe import encoding

    tool = encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in got["op12_byte_bpe"][1]:
        text = texts[r.doc_id] or ""
        ids = tool.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_equals_sql(got, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got[name][0].columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in got[name][1])
