import numpy as np
import pytest

from loomgraph.llm import toxicity
from loomgraph.llm.toxicity import Network, Scorer, _indexed, laid_out, parts_of, toxicity_scores, train, windows_of, words_of


def test_windows_cover_everything():
    for n in range(0, 200):
        covered = {i for s in windows_of(n) for i in range(s, s + toxicity.LENGTH)}
        assert covered >= set(range(n))


def test_gradients_equal_differences():
    net = Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    texts = [["bad", "w1", "w2"] * 15, ["w3", "w4"], ["w5"] * 33]
    y = np.array([1.0, 0.0, 1.0])
    ids, word, gram, n = _indexed(texts)
    at, counts = laid_out(ids)

    def loss():
        z = net.logits(net.gates(net.inputs(word, gram, n)), at)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        docs = np.log(np.add.reduceat(np.exp(toxicity.SHARPNESS * z), first)) / toxicity.SHARPNESS
        return np.mean(np.log1p(np.exp(docs)) - y * docs)

    g = net.gradients(word, gram, n, at, counts, y, np.ones(3))
    r = np.random.default_rng(1)
    for name, d in g.items():
        for _ in range(6):
            k = np.unravel_index(np.argmax(np.abs(d)), d.shape) if _ == 0 else tuple(r.integers(s) for s in d.shape)
            old = net.w[name][k]
            net.w[name][k] = old + 1e-3
            up = loss()
            net.w[name][k] = old - 1e-3
            down = loss()
            net.w[name][k] = old
            assert (up - down) / 2e-3 == pytest.approx(d[k], abs=2e-4, rel=0.02), name


def test_parts_of_a_long_text_score_alike(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000)) + " awful " + " ".join(f"w{i % 89}" for i in range(2000))
    texts = ["awful w1 w2", "w1 w2 w3", "w5 w6 awful", "w5 w6 w7"] * 8
    net = train(texts, [1, 0, 1, 0] * 8, steps=40)
    whole = Scorer(net).scores([text, "w1 w2", "", None])
    monkeypatch.setattr(toxicity, "PART", 500)
    parts = list(parts_of(text))
    words = parts[0] + [w for p in parts[1:] for w in p[toxicity.LENGTH - toxicity.STEP :]]
    assert words == text.split() and len(parts) > 10
    monkeypatch.setattr(toxicity, "REMEMBERED", 10)
    got = Scorer(net).scores([text, "w1 w2", "", None])
    assert whole[0] > 0.5 and got[0] > 0.5 and got[1:] == whole[1:] and whole[2:] == [0.0, 0.0]


def test_scores_do_not_depend_on_what_is_scored_beside():
    r = np.random.default_rng(4)
    texts = ["awful w1 w2", "w1 w2 w3", "w5 w6 awful", "w5 w6 w7"] * 8
    net = train(texts, [1, 0, 1, 0] * 8, steps=40)
    asked = [" ".join(f"w{k}" for k in r.integers(0, 3000, n)) + " awful" * (n % 2) for n in (1, 2, 5, 31, 32, 33, 100, 700, 3000)]
    alone = [Scorer(net).scores([t])[0] for t in asked]
    for n in (1, 7, 60, 300):
        others = [" ".join(f"v{k}" for k in r.integers(0, 500, 60)) for _ in range(n)]
        assert Scorer(net).scores(others + asked + others[: n // 2])[n : n + len(asked)] == alone


def test_a_long_text_has_one_grid_of_windows(monkeypatch):
    run = "".join(chr(0x4E00 + i % 999) for i in range(5000))
    for text in (" ".join(f"w{i}" for i in range(n)) for n in (1, 8, 9, 32, 33, 56, 57, 400, 1000)):
        for whole in (text, text + " " + run, run + text):
            words = words_of(whole)
            want = [words[s : s + toxicity.LENGTH] for s in windows_of(len(words))]
            with monkeypatch.context() as m:
                m.setattr(toxicity, "PART", 300 if len(whole) >= 300 else 1)
                got = [p[s : s + toxicity.LENGTH] for p in parts_of(whole) for s in windows_of(len(p))]
            assert got == want


def test_two_megabytes_are_read_to_the_end():
    texts = ["awful w1 w2", "w1 w2 w3", "w5 w6 awful", "w5 w6 w7"] * 8
    scorer = Scorer(train(texts, [1, 0, 1, 0] * 8, steps=40))
    plain = " ".join(f"w{i % 9}" for i in range(700_000))
    calm, bad = scorer.scores([plain, plain + " awful" * 12])
    assert len(plain) > 2_000_000 and calm < 0.5 and bad > calm + 0.1


def test_runs_without_spaces_are_read_to_their_end():
    for n in (1, 63, 64, 65, 119, 120, 121, 500):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = words_of(f"a {run} b")[1:-1]
        assert pieces[0] + "".join(p[toxicity.SHARED :] for p in pieces[1:]) == run and max(map(len, pieces)) <= 64
    r = np.random.default_rng(3)
    filler = lambda: "".join(chr(0x4E00 + i) for i in r.integers(0, 60, 150))
    bad = "\u6000\u6001\u6002\u6003" * 16
    texts, labels = [filler() + bad * (k % 2) + filler() for k in range(240)], [k % 2 for k in range(240)]
    got = np.array(Scorer(train(texts[:200], labels[:200], steps=100)).scores(texts[200:]))
    assert ((got >= 0.5) == np.array(labels[200:])).mean() > 0.9


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = toxicity_scores(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = [r.predicted for r in held if r.toxic == 1]
    clean = [r.predicted for r in held if r.toxic == 0]
    print(len(hit), np.mean(hit), len(clean), np.mean(clean))
    # 350 toxic rows are learned from here, in four languages; with 1,200 of them all but a few in a thousand are right
    assert np.mean(hit) > 0.75 and np.mean(clean) < 0.03


def test_nulls_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "hi", 1), (3, "hi", 1), (3, "hi", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert sorted((str(r.doc_id), r.score, r.predicted) for r in toxicity_scores(docs, labels).collect()) == [("1", 0.0, 0), ("2", 0.0, 0), ("3", 0.0, 0), ("3", 0.0, 0), ("None", 0.0, 0)]
    assert toxicity_scores(docs.limit(0), labels).count() == 0


def test_unset_memory_is_never_read(monkeypatch):
    texts = ["hello there you", "a", "", "some words of a longer text " * 9]
    want = Scorer(Network()).scores(texts)

    class Poisoned(Scorer):
        def forget(self):
            super().forget()
            self.table[:] = np.nan

    got = Poisoned(Network()).scores(texts)
    assert got == want and np.isfinite(got).all()
