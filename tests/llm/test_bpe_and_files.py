"""Tokenisers against the libraries, the token files' round trip, Elias-Fano against lists."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigipanel.llm import bpe, token_files
from vigipanel.llm.common import CACHE_ENTRIES, LATIN, latin_pattern
from vigipanel.llm.elias_fano import EliasFano
from vigipanel.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, part int, ids string, place string"
TEXTS = ["", None, "a", "Hello  world\n\n 's", " x", "x ", "été über niño " * 30, "ab" * 3000, "<|endoftext|> 你好 😀", "same", "same"]


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 6 else None, t, 1, "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)


def ids_of(cache, text, kind):
    return np.frombuffer(b"".join(cache.values_of(text)), kind).tolist()


def test_chunks_give_the_libraries_ids(tik):
    own, files = bpe.encoder(RANKS, public_tokenizers.PATTERN), token_files.encoder(JSON)
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    draw = random.Random(7)
    parts = [*"aabetoinhrsXY  \n\t.,'19-éñß好мир😀  ", "'s", "'ll", " the", "<|endoftext|>", "   "]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        assert ids_of(own, text, "<i4") == tik.encode_ordinary(text)
        assert ids_of(files, text, "<u4") == library.encode(text, add_special_tokens=False).ids


def test_latin_texts_are_cut_at_once_and_kept_by_piece(tik):
    assert latin_pattern(public_tokenizers.PATTERN).findall("l'été x9  y") == ["l", "'", "été", " x", "9", " ", " y"]
    assert latin_pattern(r"\p{Lu}+|.") is None
    own, files = bpe.encoder(RANKS, public_tokenizers.PATTERN), token_files.encoder(JSON)
    library = Tokenizer.from_file(JSON)
    for cache in (own, files):
        cache.forget()
    for c in map(chr, range(ord(LATIN))):
        for text in (f"a{c}b", f"a {c} b", f"a{c * 3}b", f"a  {c}9"):
            assert ids_of(own, text, "<i4") == tik.encode_ordinary(text)
            assert ids_of(files, text, "<u4") == library.encode(text, add_special_tokens=False).ids
    # A word is kept once, whatever stands beside it.
    for cache in (own, files):
        assert not len(cache) and len(cache.others)


def test_caches_of_byte_bpe_stay_small(monkeypatch):
    own = bpe.Vocabulary(bpe.read_ranks(RANKS))
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    draw = random.Random(5)
    for _ in range(200):
        bpe.Prefixes(own, bytes(draw.choices(b"abcdefghij", k=12)))
        assert len(own.pairs) <= 50 and len(own.older) <= 50
    cache = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    assert cache.entries == cache.others.entries == bpe.PIECES < CACHE_ENTRIES


@given(st.binary(min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_prefix_table_is_the_definition(data):
    vocabulary = bpe.vocabulary(RANKS)
    want = [vocabulary.ranks[p] for p in vocabulary.merges(data)[0]]
    assert bpe.Prefixes(vocabulary, data).tokens() == want


@given(st.text("abcdeinrst ", max_size=30), st.text("abcdeinrst ", max_size=10), st.integers(0, 30), st.integers(0, 10))
@settings(max_examples=100, deadline=None)
def test_appends_and_edits_equal_encoding_anew(text, more, start, size):
    vocabulary, data, new = bpe.vocabulary(RANKS), text.encode(), more.encode()
    prefixes = bpe.Prefixes(vocabulary, data)
    prefixes.append(new)
    assert prefixes.tokens() == bpe.Prefixes(vocabulary, data + new).tokens()
    assert prefixes.tokens(len(data)) == bpe.Prefixes(vocabulary, data).tokens()
    whole = data + new
    start = min(start, len(whole))
    prefixes.edit(start, min(start + size, len(whole)), b"tion")
    assert prefixes.tokens() == bpe.Prefixes(vocabulary, whole[:start] + b"tion" + whole[start + size :]).tokens()


def test_encode_and_decode_rows(docs, tik):
    rows = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(rows) == len(TEXTS) + 1
    got = sorted((bytes(r.bytes), r.ids) for r in rows)
    assert got == sorted(((t or "").encode(), tik.encode_ordinary(t or "")) for t in [*TEXTS, TEXTS[3]])


def test_unknown_id_fails(spark):
    bad = spark.createDataFrame([(1, [60000])], "doc_id bigint, ids array<int>")
    with pytest.raises(Exception, match="60000"):
        bpe.decode(bad, RANKS).collect()


def test_token_files_round_trip(spark, docs):
    path = scratch_path(spark, "files")
    token_files.write_token_files(docs.repartition(3), JSON, path)
    rows = token_files.read_token_files(spark, path).collect()
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    want, start = {}, 0
    ordered = [(None, TEXTS[6]), *((i, TEXTS[i]) for i in range(len(TEXTS)) if i != 6)]
    ordered.insert(5, ordered[4])
    for i, text in ordered:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append((start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {}
    for r in sorted(rows, key=lambda r: r.start):
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, bytes(r.ids)))
    assert got == want


def test_small_shards_and_one_hot_id(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 50)
    rows = [(5 if i % 3 else i, f"word {i} " * (i % 7)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    path = scratch_path(spark, "files")
    token_files.write_token_files(docs, JSON, path)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert sorted(r.doc_id for r in got) == [r.doc_id for r in got]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert spark.read.parquet(path).count() > 5
    assert len(got) == 200


def test_empty_table(spark, docs):
    path = scratch_path(spark, "files")
    token_files.write_token_files(docs.limit(0), JSON, path)
    assert token_files.read_token_files(spark, path).count() == 0
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_shard_selects_one_document():
    ids = [np.arange(n, dtype="<u4") + 70_000 * (n == 9) for n in (3, 0, 1, 9, 1000)]
    shard = token_files.Shard(token_files.pack_shard([x.tobytes() for x in ids]))
    for i, x in enumerate(ids):
        assert shard.ids(i).tolist() == x.tolist()


@given(st.lists(st.integers(0, 5000), max_size=900), st.integers(0, 100_000))
@settings(max_examples=80, deadline=None)
def test_elias_fano(steps, more):
    values = np.cumsum(steps, dtype=np.int64) if steps else np.empty(0, np.int64)
    universe = int(values[-1] if len(values) else 0) + more
    code = EliasFano.from_bytes(EliasFano.of(values, universe).to_bytes())
    assert code.all().tolist() == values.tolist()
    assert [code.select(i) for i in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        code.select(len(values))


def test_crc_matches_spark(spark):
    data = np.array([1, 2, 3], "<u4").tobytes()
    assert spark.range(1).select(F.crc32(F.lit(data))).first()[0] == zlib.crc32(data)


def test_caches_keep_what_is_used_and_stay_bounded(monkeypatch):
    from vigipanel.llm import common

    monkeypatch.setattr(common, "CACHE_ENTRIES", 10)
    made = []
    cache = common.Cache(lambda key: made.append(key) or key.upper())
    for i in range(200):
        assert cache["the"] == "THE" and cache[f"w{i}"] == f"W{i}"
        assert len(cache) + len(cache.old) <= 20
    assert made.count("the") == 1 and len(made) == 201
    cache.forget()
    assert not cache and not cache.old and cache["the"] == "THE" and made.count("the") == 2


def test_a_task_of_another_operator_frees_the_caches(monkeypatch):
    from vigipanel.llm import common

    monkeypatch.setattr(common, "_KEPT", {})
    cache = common.Cache(str.upper)
    common.keep("one", cache.forget)
    assert cache["a"] == "A"
    common.leave_to("one")
    assert len(cache) == 1
    common.leave_to("another")
    assert len(cache) == 0


def test_pairs_in_two_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 4)
    own = bpe.Vocabulary(bpe.read_ranks(RANKS))
    text = "Neighbours are known twice, in a young and in an old table. " * 3
    once = bpe.Prefixes(own, text.encode()).tokens()
    assert once == bpe.Prefixes(own, text.encode()).tokens() == bpe.Prefixes(bpe.vocabulary(RANKS), text.encode()).tokens()
    assert len(own.pairs) <= 4 and len(own.older) <= 4
