import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from loomgraph.llm import byte_bpe
from loomgraph.llm.byte_bpe import ByteBPE, PerfectHash, decoded_documents, encoded_documents, token_digests

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(1)
    some = ["", " ", "\n\n \t x", "don't 123 é日本語 🙂‍\x1c \x85  a", "a" * 3000, "<|endoftext|>", "Ünï çode  \r\n  end ", "\x1c\x1d\x1e\x1f x"]
    some += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF), r.randrange(0x1F300, 0x1F600)])) for _ in range(200)) for _ in range(40)]
    return some + ["".join(r.choice("ab  \n'sé1") for _ in range(300)) for _ in range(40)]


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    assert PerfectHash(keys).index(keys).tolist() == list(range(5000))


def test_equals_the_library_and_round_trips():
    coder, other = ByteBPE.from_file(PATH, PATTERN), library()
    for t in texts():
        assert coder.encode(t) == other.encode_ordinary(t), repr(t)
        assert coder.decode(coder.encode(t)) == t.encode()


def test_chunks_change_nothing(monkeypatch):
    coder = ByteBPE.from_file(PATH, PATTERN)
    want = [coder.digest(t) for t in texts()]
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(byte_bpe, "CHUNK", 7)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    coder.known.clear()
    coder.plain.clear()
    assert [coder.digest(t) for t in texts()] == want


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = library()
    got = {r.doc_id: tuple(r)[1:] for r in token_digests(docs, PATH, PATTERN).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = other.encode_ordinary(text)
        assert got[doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = decoded_documents(encoded_documents(docs, PATH, PATTERN), PATH, PATTERN)
    assert back.exceptAll(docs.select("doc_id", "text")).count() == 0


def test_nulls_and_empty(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "hi", "x"), (3, "hi", "x"), (3, "hi", "x")]
    got = token_digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, PATTERN).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256 == none) for r in got) == [("1", 0, True), ("2", 0, True), ("3", 1, False), ("3", 1, False), ("None", 1, False)]
    assert token_digests(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0
