import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import packing
from loomgraph.llm.packing import Encoder, cuts, packed, plan

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(monkeypatch):
    r, want = random.Random(1), library()
    texts = ["", " ", "\n\n \t x", "don't 123 é日本語 🙂‍\x1c \x85  a", "a" * 300, "<|endoftext|>", "''s 's !'s", "Ünï çode  \r\n  end "]
    texts += ["".join(chr(r.choice([r.randrange(0, 127), r.randrange(160, 0x2FFF), r.randrange(0x1F300, 0x1F600)])) for _ in range(200)) for _ in range(40)]
    texts += ["".join(r.choice("ab  \n'sé1!") for _ in range(300)) for _ in range(60)]
    texts += [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(200)) for _ in range(20)]
    for part, remembered, longest in ((10**6, 10**8, 64), (50, 10**8, 3), (7, 2000, 64)):
        monkeypatch.setattr(packing, "PART", part)
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        monkeypatch.setattr(packing, "LONGEST", longest)
        coder = Encoder(PATH, PATTERN)
        for t in texts:
            assert np.frombuffer(coder.whole(t), "<u4").tolist() == want(t), (part, t)
    assert Encoder(PATH, PATTERN).whole(None) == b""


def test_cuts():
    assert cuts(5, 10) == [(0, 5)] and cuts(10, 10) == [(0, 10)] and cuts(23, 10) == [(0, 3), (3, 10), (13, 10)]


def laid_out(counts, capacity):
    steps, opened = plan(counts, capacity)
    bins, rows = defaultdict(list), steps.tolist()
    for (n, number, first, offset, each), after in zip(rows, [*rows[1:], [None, 0]]):
        for q in range((after[1] if after[0] == n else counts[n]) - number):
            bins[first + q // each].append((offset + q % each * n, n))
    assert sorted(bins) == list(range(opened))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    assert Counter(n for own in bins.values() for _, n in own) == Counter(counts)
    return opened


def best_fit(lengths, capacity):
    """One piece at a time: longest first, where it leaves the least room."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_plan_holds_and_packs_as_well_as_piece_by_piece():
    r = random.Random(3)
    assert laid_out({}, 10) == 0 and laid_out({10: 3}, 10) == 3 and laid_out({4: 5}, 10) == 3 and laid_out({3: 7}, 10) == 3 and laid_out({1: 25}, 10) == 3
    for _ in range(200):
        capacity = r.choice([10, 30, 100])
        counts = {r.randrange(1, capacity + 1): r.choice([1, 2, 3, 20]) for _ in range(r.randrange(1, 20))}
        assert laid_out(counts, capacity) <= best_fit(Counter(counts).elements(), capacity) * 1.03 + 1
    large = {n: r.randrange(1, 9) for n in range(35, 101, 3)}
    pairs = sum(large.values()) - laid_out(large, 100)
    lengths, most = sorted(Counter(large).elements()), 0
    low, high = 0, len(lengths) - 1
    while low < high:  # the most pairs there can be: the longest with the shortest where that fits
        if lengths[low] + lengths[high] <= 100:
            most, low = most + 1, low + 1
        high -= 1
    assert pairs == most


@pytest.mark.parametrize("capacity", [2048, 100])
def test_pieces_of_documents(spark, capacity):
    r, want = random.Random(4), library()
    texts = [None, "", "word", "again " * 5000] + [" ".join(r.choice(["alpha", "beta", "ünder", "\n"]) for _ in range(r.choice([1, 40, 800]))) for _ in range(150)] + ["same copy here"] * 200
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)] + [(None, "no id", 1, "y"), (3, "again", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, number string").repartition(7)
    got = packed(df, PATH, PATTERN, capacity).collect()
    expect = []
    for i, t, *_ in rows:
        ids = [*want(t or ""), 0]
        expect += [(i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())) for k, (start, n) in enumerate(cuts(len(ids), capacity))]
    assert Counter(tuple(x[:5]) for x in got) == Counter(expect)
    room = defaultdict(list)
    for x in got:
        room[x.sequence_id].append((x.offset, x.length))
    for own in room.values():
        assert sorted(own)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:])) and sum(n for _, n in own) <= capacity
    least = -(-sum(x.length for x in got) // capacity)
    assert len(room) <= max(least * 1.02 + 1, best_fit([x.length for x in got], capacity))
    assert packed(df.limit(0), PATH, PATTERN).count() == 0
