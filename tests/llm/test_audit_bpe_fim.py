"""Filter audit, byte-level BPE and fill-in-the-middle against brute force, with odd input."""

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwell.llm import byte_bpe, fim, filter_audit

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string"


# ---- filter audit


def plain_audit(docs, labels):
    """Filters applied one after another to every document, for every order."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))

    def fails(i, t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        return {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and least.get(t, i) < i,
        }

    rows = [(lang or "", i, fails(i, t or "")) for i, t, lang in docs]
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        shares = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                early = [r for r in mine if r[1][f] and any(r[1][g] for g in order[: k - 1])]
                left = [r for r in left if not r[1][f]]
                shares[f] += len(gone)
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                out[part, "".join(order), k] = [len(left), len(gone), len(early), only, sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shares[order[k - 1]])
    return out


def audited(spark, docs, labels):
    got = filter_audit.audit_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}


def test_audit_equals_filters_one_by_one(spark):
    rng = np.random.default_rng(3)
    long = " ".join(f"w{i}" for i in range(210))
    texts = [None, "", long, long + " #", "AB " * 250, "ab " * 250, long.upper(), long + " x\x0bY", "%", "x " * 199]
    docs = [(int(i), texts[rng.integers(len(texts))], ["en", "de", None, ""][rng.integers(4)]) for i in range(90)]
    docs += [(5, long, "en"), (5, long, "en"), (None, long, "de"), (None, "only here", "fr"), (3, "only here", "fr")]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 90, 2)] + [(2, 1, None), (4, None, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_nothing_and_without_labels(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "a", None)], []) == plain_audit([(1, "a", None)], [])


def test_audit_ignores_columns_of_other_names(spark):
    docs = [(1, "a b", "en"), (2, "a b", "en")]
    more = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("part", "same", "n", "A", "later", "good", "id")})
    got = filter_audit.audit_documents(more, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): r.shapley for r in got.collect()} == {k: v[-1] for k, v in plain_audit(docs, []).items()}


@given(st.integers(1, 4), st.integers(0, 1 << 30))
@settings(max_examples=20, deadline=None)
def test_contraction_equals_sums_over_cells(axes, seed):
    rng = np.random.default_rng(seed)
    tensor = rng.integers(0, 50, (2, *[2] * axes))
    chosen = [[(filter_audit.PASS, filter_audit.FAIL, filter_audit.ALL)[rng.integers(3)] for _ in range(axes)] for _ in range(7)]
    want = [[sum(int(tensor[(w, *cell)]) * int(np.prod([c[x] for c, x in zip(choice, cell, strict=True)])) for cell in np.ndindex(*[2] * axes)) for choice in chosen] for w in range(2)]
    assert filter_audit.contract(tensor, chosen).tolist() == want


# ---- byte-level BPE

ODD = ["", " ", "  ", "a", " a", "a ", "it's we'll", "a  b", "a\nb \n c", "x y 　z", "12 345,67", "\U0001f600 ՘՘'s", "tab\t end ", "<|endoftext|> x", "\x00 \x1c\x1d y", "é café", "日本語 テスト", "'s 's''s", "a " * 3000 + " "]


def encoded(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return byte_bpe.encode(df.withColumns(more), VOCABULARY, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return byte_bpe.encoding(VOCABULARY, public_tokenizers.PATTERN)


def test_ids_equal_the_library_and_decode_to_the_text(spark, library):
    docs = [*enumerate(ODD), (100, None), (0, "a"), (0, "a")]
    ids = encoded(spark, docs)
    back = byte_bpe.decode(ids.withColumn("kept", F.col("ids")), VOCABULARY)
    rows = sorted((r.doc_id, list(r.kept), bytes(r.decoded)) for r in back.collect())
    assert rows == sorted((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in docs)


@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdlv1aé՘"))), max_size=5))
@settings(max_examples=60, deadline=None)
def test_split_equals_the_library(library, texts):
    split, whole = byte_bpe.Splitter(public_tokenizers.PATTERN), byte_bpe.encoding(VOCABULARY, r"(?s:.+)")
    for t in texts:
        places = split.split(t)
        words = list(split.words)
        assert "".join(words[i] for i in places.tolist()) == t
        assert [x for i in places.tolist() for x in whole.encode_ordinary(words[i])] == library.encode_ordinary(t)


def test_split_equals_the_library_where_their_unicode_differs(library):
    whole = byte_bpe.encoding(VOCABULARY, r"(?s:.+)")
    split = byte_bpe.Splitter(public_tokenizers.PATTERN)
    chars = [*byte_bpe.stand_ins(), *range(0x250), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600]
    for c in map(chr, chars):
        for t in (f"1{c}{c}'s", f"a{c} b", f"x  {c}"):
            places = split.split(t)
            words = list(split.words)
            assert [x for i in places.tolist() for x in whole.encode_ordinary(words[i])] == library.encode_ordinary(t), (hex(ord(c)), t)
        split.clear()


def test_long_texts_blocks_and_clashing_names(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 50)
    split = byte_bpe.Splitter(public_tokenizers.PATTERN)
    text = "ab  cd1 " * 40
    words = split.split(text)
    assert "".join(list(split.words)[i] for i in words.tolist()) == text
    docs = [(i, f"word{i % 7} and{i} " * 500) for i in range(40)]
    monkeypatch.setattr(byte_bpe, "LIST_BYTES", 500)
    got = encoded(spark, docs, block=F.lit(1), list=F.lit("x"), Places=F.lit(None).cast("int"), Words=F.lit("y"), positions=F.lit(2.0), ids=F.lit(0))
    assert got.columns == ["doc_id", "block", "list", "Places", "Words", "positions", "ids"]
    assert {r.doc_id: list(r.ids) for r in got.collect()} == {i: library.encode_ordinary(t) for i, t in docs}


def test_lists_of_words_are_encoded_row_by_row(spark, library):
    rows = [(1, 0, [" word", "Ünï", "a\0b"]), (2, 0, ["Ünï"]), (2, 3, [" of many tokens that belong together", "a"])]
    packed = [(b, k, bytearray(str(n), "ascii"), bytearray(byte_bpe._packed_words([w.encode() for w in words]))) for n, (b, k, words) in enumerate(rows)]
    got = byte_bpe.encode_lists(spark.createDataFrame(packed, "block long, list long, places binary, words binary"), VOCABULARY).collect()
    whole = byte_bpe.encoding(VOCABULARY, r"(?s:.+)")
    for r in got:
        ids = [whole.encode_ordinary(w) for w in rows[int(r.places)][2]]
        assert r.block == rows[int(r.places)][0] and byte_bpe._unpacked(r.sizes).tolist() == list(map(len, ids)) and byte_bpe._unpacked(r.ids).tolist() == sum(ids, [])
    assert len(got) == 3


def test_bpe_of_nothing(spark):
    ids = encoded(spark, [])
    assert ids.collect() == [] and byte_bpe.decode(ids, VOCABULARY).collect() == []


def test_decoding_takes_nulls_and_rejects_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0])], "n int, ids array<int>")
    assert {r.n: bytes(r.decoded) for r in byte_bpe.decode(rows, VOCABULARY).collect()} == {1: b"", 2: b"", 3: next(b for b, i in byte_bpe.ranks(VOCABULARY).items() if i == 0)}
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [60000])], "n int, ids array<int>"), VOCABULARY).collect()


# ---- fill in the middle


def plain_fim(doc_id, text):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(lines), "plain", None, None, t
    if h4 % 100 < 50:
        return len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def turned(spark, docs, **more):
    df = fim.fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string").withColumns(more))
    return df.withColumn("back", fim.restored(F.col("form"), F.col("output")))


def test_turned_equals_lines_cut_plainly(spark):
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "é\nüö\n日本\r\nx", "one <P> two\n", "<S", "ends <", "<\nP\n><\nS", "\n".join("l" * (i % 37) for i in range(500)), "x" * 3000 + "\ny"]
    docs = [(7 * i + j, t) for i, t in enumerate(texts) for j in range(6)] + [(1, "a\nb"), (1, "a\nb"), (None, "a\nb\nc")]
    rows = turned(spark, docs).collect()
    assert len(rows) == len(docs) and {r.form for r in rows} == {"plain", "psm", "spm"}
    want = Counter((i, *plain_fim(i, t), t or "") for i, t in docs)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in rows) == want


def test_fim_of_nothing_and_clashing_names(spark):
    assert turned(spark, []).collect() == []
    got = turned(spark, [(3, "a\nb\n")], N=F.lit("x"), form=F.lit(1), Output=F.lit(2), id=F.lit(9), text_=F.lit("z"))
    assert got.columns == ["doc_id", "id", "text_", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    assert got.first().back == "a\nb\n"


@given(st.lists(st.integers(0, 5000), max_size=400), st.integers(1, 126))
@settings(max_examples=60, deadline=None)
def test_rank_index_is_exact_within_its_error(steps, error):
    offsets = np.cumsum(np.array([0, *steps], np.int64))
    index = fim.fit_ranks(offsets, error)
    ranks = np.arange(len(offsets))
    assert (index.offsets(ranks) == offsets).all() and abs(index.predict(ranks) - offsets).max() <= error + 1
    even = fim.fit_ranks(np.arange(1000) * 17)
    assert len(even.first) == 1 and len(fim.fit_ranks(np.array([0])).first) == 1


def test_boundaries_of_rows():
    from sparkwell.llm.text import utf8

    data, offsets = utf8(pa.array(["é\nb", None, "", "\n", "x"]))
    points, firsts, n = fim.line_ranks(data, offsets)
    assert n.tolist() == [2, 0, 0, 1, 1] and firsts.tolist() == [0, 3, 4, 5, 7]
    assert points.tolist() == [0, 2, 3, 3, 3, 3, 4, 4, 5]


def test_rates(spark):
    docs = spark.createDataFrame([(i, "a\nb\n") for i in range(300)], "doc_id long, text string")
    forms = Counter(r.form for r in fim.fill_in_middle(docs, rate=50, spm_rate=0).select("form").collect())
    assert set(forms) == {"plain", "psm"} and 100 < forms["plain"] < 200
