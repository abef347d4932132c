"""Token counts and the BPE automaton against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidebars.llm import bpe_automaton as ba
from tidebars.llm import token_counts as tc

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return ba.WordEndBpe(PATH)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def same(model, library, text):
    ids, decoded = model.encode(text.encode())
    want = ids_of(library, text)
    assert np.frombuffer(ids, "<u4").tolist() == want, text
    assert decoded.decode() == library.decode(want, skip_special_tokens=False), text


SPECIAL = ["", "a<|endoftext|>b <|startoftext|>c", "ΑΣ ΣΑΣ Σ. İI ſK", "aaaa aaaaa aa " + "a" * 31, "é ́x a\x1cb\x1f \x85  z ", "日本語テキスト 🎉🎉👍🏽", "it's can't we'll I'M", "\x00\x01\x7f", "x" * 5000, "½²③ १२", "!!!!!!!!???....----====", "가각힣 가", "<|endoftext|><|endoftext|>"]


@pytest.mark.parametrize("text", SPECIAL)
def test_special_texts(model, library, text):
    same(model, library, text)


def test_all_characters_of_the_first_plane(model, library):
    for a in range(0, 0x10000, 300):
        chars = [chr(x) for x in range(a, a + 300) if not 0xD800 <= x < 0xE000]
        same(model, library, " ".join(chars))
        same(model, library, "".join(chars))


def test_letter_runs(model, library):
    rng = random.Random(3)
    for _ in range(300):
        same(model, library, "".join(rng.choice("abeinrstz!'9é") for _ in range(rng.randint(1, 60))))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(model, library, text):
    same(model, library, text.encode("utf-8", "replace").decode())


def test_small_merges_by_hand():
    """A self-merge reads from the left; a pair that an earlier merge has taken never stands."""
    vocab = {"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4}
    auto = ba.Automaton(vocab, [("a", "a"), ("a", "b"), ("aa", "b")])
    auto.build_tables(lambda t: ["ab".index(c) for c in t])
    got = lambda t: [auto.label[i] for i in auto.encode(["ab".index(c) for c in t])]
    assert got("aaa") == ["aa", "a"] and got("aaaa") == ["aa", "aa"] and got("ab") == ["ab"] and got("aab") == ["aab"] and got("aaab") == ["aa", "ab"]
    assert got("ba") == ["b", "a"] and got("") == []


def test_round_trip_and_digests(make, odd, library):
    docs = make(odd)
    rows = ba.encode(docs, PATH).collect()
    want = sorted(((i, ids_of(library, t or "")) for i, t in odd), key=repr)
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=repr) == want
    assert all(r.n_tokens == len(r.ids) and r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in rows)
    short = sorted(((r.doc_id, r.ids_sha256) for r in ba.encode(docs, PATH, digests=True).collect()), key=repr)
    assert short == sorted(((i, hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in want), key=repr)
    assert ba.encode(make([]), PATH).count() == 0


def test_memo_generations(model, library, monkeypatch):
    monkeypatch.setattr(ba, "MEMO", 10)
    monkeypatch.setattr(ba, "MOVES", 50)
    text = " ".join(f"word{n} don't {n}!" for n in range(60))
    same(model, library, text + " " + text)


@pytest.mark.parametrize("by_pieces", [True, False])
def test_counts(make, odd, library, tmp_path, by_pieces):
    spaces = F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ")
    got = tc.token_counts(make([*odd, (77, "a<|endoftext|>b")]), PATH, str(tmp_path / "cache"), normalise=spaces, by_pieces=by_pieces).collect()
    want = [(i, len((t or "").encode()), len(ids_of(library, t or ""))) for i, t in [*odd, (77, "a<|endoftext|>b")]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_cache_is_used_and_grows(spark, make, tmp_path):
    path = str(tmp_path / "cache")
    first = tc.token_counts(make([(1, "one two"), (2, "one two"), (3, "three")]), PATH, path)
    assert {r.doc_id: r.n_tokens for r in first.collect()} == {1: 2, 2: 2, 3: 1}
    stored = spark.read.parquet(path)
    assert stored.count() == 2
    # a count that only the cache can give shows that a known content is not encoded again
    stored.limit(0).unionByName(spark.createDataFrame([(bytearray.fromhex(hashlib.sha256(b"marked").hexdigest()), tc.tokenizer_digest(PATH), 777)], stored.schema)).write.mode("append").parquet(path)
    again = tc.token_counts(make([(1, "one two"), (4, "marked"), (5, "four five six")]), PATH, path)
    assert {r.doc_id: r.n_tokens for r in again.collect()} == {1: 2, 4: 777, 5: 3}
    assert spark.read.parquet(path).count() == 4
    # another version of the tokenizer shares nothing
    other = tc.token_counts(make([(4, "marked")]), PATH, path, by_pieces=True)
    assert [r.n_tokens for r in other.collect()] == [1]


def test_other_libraries(make, tmp_path):
    spm = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = spm.SentencePieceProcessor(model_file=path)
    got = tc.token_counts(make([(1, "Hello there, world"), (2, None)]), path, str(tmp_path / "c")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: len(model.encode("Hello there, world")), 2: 0}
    assert tc.token_counts(make([]), path, str(tmp_path / "d")).count() == 0


def test_a_worker_keeps_the_values_of_one_operator_only():
    """The automaton's tables are not held while the next operator runs in the same worker."""
    from tidebars.llm import common

    def keeps(name, value):
        def fn(batches):
            return common.kept_in_worker(name, lambda: value)

        return fn

    common.worker_of("first")
    big = keeps("tables", [1])(None)
    common.worker_of("first")
    assert keeps("tables", [2])(None) is big
    common.worker_of("second")
    assert keeps("tables", [3])(None) == [3]


def test_operators_name_themselves_to_their_workers(spark):
    import pyarrow as pa

    from tidebars.llm import common

    def owner_of(module):
        def fn(batches):
            for b in batches:
                left = sorted(vars(common._store()).get("_kept", {}))
                common.kept_in_worker(module, dict)
                yield pa.RecordBatch.from_arrays([pa.array([",".join(left)] * b.num_rows)], ["left"])

        fn.__module__ = module
        return common.map_arrow(spark.range(0, 8, 1, 1), fn, "left string")

    for _ in range(2):
        assert {r.left for r in owner_of("one").collect()} <= {"", "one"}
        assert {r.left for r in owner_of("two").collect()} <= {"", "two"}
