"""Every round of Baum-Welch takes in every training document to its end; the trained model against plain recursions."""

from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import hmm


def ready(spark, seq, lengths, cuts, held=()):
    first = np.concatenate([[0], np.cumsum(lengths)])
    rows = [
        (k, list(range(a, b)), [i in held for i in range(a, b)], lengths[a:b].astype("<u4").tobytes(), hmm._squeeze(seq[first[a] : first[b]]), [0] * (b - a), [0.0] * (b - a), [0.0] * (b - a))
        for k, (a, b) in enumerate(cuts)
    ]
    return spark.createDataFrame(rows, hmm.READY).repartition(len(cuts))


def plain_round(model, docs):
    """Expected counts by the textbook recursions in double precision, one text at a time."""
    states = len(model.start)
    starts, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((hmm.CLASSES, states))
    for s in docs:
        alpha, scale = np.zeros((len(s), states)), np.zeros(len(s))
        for t, k in enumerate(s):
            a = (model.start if t == 0 else alpha[t - 1] @ model.move) * model.emit[k]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
        beta = np.ones(states)
        for t in range(len(s) - 1, -1, -1):
            emitted[s[t]] += alpha[t] * beta
            if t == 0:
                starts += alpha[0] * beta
            else:
                w = model.emit[s[t]] * beta / scale[t]
                moves += np.outer(alpha[t - 1], w) * model.move
                beta = model.move @ w
    return starts, moves, emitted


def test_trained_model_is_that_of_plain_rounds(spark):
    rng = np.random.default_rng(5)
    lengths = np.array([2600, 1, 700, 2100, 60, 2])
    seq = np.concatenate([np.where(np.arange(k) < 1500, rng.integers(0, 20, k), rng.integers(20, 40, k)) for k in lengths]).astype("<u4")
    n = np.bincount(seq, minlength=hmm.CLASSES)
    got = hmm.train(ready(spark, seq, lengths, [(0, 2), (2, 6)], held={2}), n, 3)
    share = (n + 1) / (n + 1).sum()
    want = hmm.begin_model(n, 3)
    docs = [s for i, s in enumerate(np.split(seq, np.cumsum(lengths)[:-1])) if i != 2]
    for _ in range(hmm.ROUNDS):
        want = hmm.maximise(*plain_round(want, docs), share)
    assert got.start == pytest.approx(want.start, rel=1e-2, abs=1e-3)
    assert got.move == pytest.approx(want.move, rel=1e-2, abs=1e-4)
    assert got.emit[:40] == pytest.approx(want.emit[:40], rel=1e-2, abs=1e-4)


def test_rounds_see_late_text():
    """What a text's first 5,000 tokens don't hold is learnt all the same, and a long text's moves are all counted."""
    lengths = np.array([9000, 30])
    seq = np.concatenate([np.r_[np.zeros(5000), np.full(4000, 7)], np.zeros(30)]).astype("<u4")
    starts, moves, emitted = hmm.expectations(hmm.begin_model(np.bincount(seq, minlength=hmm.CLASSES), 2), seq, lengths)
    assert starts.sum() == pytest.approx(2) and moves.sum() == pytest.approx(8999 + 29, rel=1e-5)
    assert emitted[7].sum() == pytest.approx(4000, rel=1e-5) and emitted[0].sum() == pytest.approx(5030, rel=1e-5)


def test_moves_add_up_alike_in_any_slices(monkeypatch):
    """A sum over tokens in single precision would differ from slice to slice, and from one machine's BLAS to another's."""
    rng = np.random.default_rng(8)
    lengths = np.array([30_000, 5, 9000])
    seq = rng.integers(0, 50, lengths.sum()).astype("<u4")
    model = hmm.begin_model(np.bincount(seq, minlength=hmm.CLASSES), 4)
    made = []
    for steps in (100, 1 << 10, 1 << 17):
        monkeypatch.setattr(hmm, "MOVES_AT_ONCE", steps)
        made.append(hmm.expectations(model, seq, lengths)[1])
    assert made[0] == pytest.approx(made[1], rel=1e-9) and made[0] == pytest.approx(made[2], rel=1e-9)
    assert made[0].sum() == pytest.approx(lengths.sum() - 3, rel=1e-9)


def test_unlikely_moves_stay_finite():
    model = hmm.begin_model(np.ones(hmm.CLASSES, np.int64), 2)
    model.emit[:, 0], model.emit[:, 1] = 1e-12, 1e-12
    model.emit[5, 0] = model.emit[6, 1] = 1 - 1e-9
    model.move = np.array([[1 - 1e-6, 1e-6], [1e-6, 1 - 1e-6]])
    seq = np.tile([5, 6, 5, 5, 6], 400)
    made = hmm.expectations(model, seq, np.array([2000]))
    assert all(np.isfinite(x).all() for x in made) and made[1].sum() == pytest.approx(1999, rel=1e-4)
    plain = plain_round(model, [seq])
    assert made[1] == pytest.approx(plain[1], rel=1e-3)
    assert np.isfinite(hmm.forward(model, seq, np.array([2000]))).all()


def test_corpus_counts_return_to_every_block(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 200)
    monkeypatch.setattr(hmm, "PART_WORDS", 7)
    rows = [(i, f"the word{i % 7} only{i} the " * (i % 3 + 1)) for i in range(60)] + [(None, None), (70, ""), (70, "x")]
    table = hmm.written(hmm.blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "blocks")
    blocks = table.collect()
    total, kind = Counter(), {}
    for r in blocks:
        own = list(zip(np.frombuffer(r["hashes"], "<u8").tolist(), hmm._expand(r["kinds"], "<u2").tolist(), hmm._expand(r["train"]).tolist(), strict=True))
        assert [h for h, _, _ in own] == sorted(h for h, _, _ in own)
        for h, k, c in own:
            total[h] += c
            kind[h] = k
    n_train, n_words = sum(r["n_train"] for r in blocks), sum(r["n_words"] for r in blocks)
    assert len(blocks) > 5 and n_train == sum(total.values())
    counts = hmm.written(hmm.counted(table, n_train, n_words), "counts")
    got = {}
    for r in sorted(counts.where("block IS NOT NULL").collect(), key=lambda r: r["part"]):
        got.setdefault(r["block"], []).extend(zip(hmm._expand(r["counts"], "<u8").tolist(), hmm._expand(r["classes"], "<u2").tolist(), strict=True))
    for r in blocks:
        hashes = np.frombuffer(r["hashes"], "<u8")
        cls = hmm.classes_of(hashes, np.array([kind[h] for h in hashes.tolist()]), np.array([total[h] for h in hashes.tolist()]), n_train)
        assert got[r["block"]] == [(total[h], k) for h, k in zip(hashes.tolist(), cls.tolist(), strict=True)]
    n, v = hmm.class_totals(counts)
    assert n.sum() == n_train and v.sum() == sum(c > 0 for c in total.values()) and n[hmm.END_CLASS] == total[hmm.END_HASH & (1 << 64) - 1]
