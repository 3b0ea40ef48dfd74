"""Support scores and prefix searches against plain versions, and how much work they leave out."""

import difflib
import random
from collections import Counter

import numpy as np
import pytest

from vodmill.operators import captions as T
from vodmill.operators import vectors as V
from vodmill.plans.catalog import QUERIES


def plain_support(claim, context):
    n = len(claim)
    if not n or not context:
        return 0.0
    if " ".join(claim) in " ".join(context):
        return 1.0
    best = 0.0
    for width in (n, n + max(3, min(12, n // 2))):
        for start in range(len(context)):
            window = context[start:start + width]
            shared = sum((Counter(claim) & Counter(window)).values())
            best = max(best, 0.65 * difflib.SequenceMatcher(None, claim, window, autojunk=False).ratio() + 0.35 * shared / n)
    return best


def test_scores_of_near_claims_equal_a_plain_version():
    rng = random.Random(1)
    for _ in range(250):
        words = "abcdefghijklm"[:rng.randint(2, 13)]
        context = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        at = rng.randrange(len(context) + 1)
        claim = [w if rng.random() < 0.8 else rng.choice(words + "z") for w in context[at:at + rng.randint(0, 14)]] or [rng.choice(words)]
        assert T.score_support(claim, context) == plain_support(claim, context)


def test_few_windows_are_measured(monkeypatch):
    rng = random.Random(2)
    context = [f"w{rng.randrange(200)}" for _ in range(400)]
    claim = [w if i % 7 else "zqa" for i, w in enumerate(context[120:140])]
    count, real = [0], difflib.SequenceMatcher

    def counted(*a, **b):
        count[0] += 1
        return real(*a, **b)

    want = plain_support(claim, context)
    monkeypatch.setattr(difflib, "SequenceMatcher", counted)
    assert T.score_support(claim, context) == want and count[0] < 40  # of 800 windows


def test_near_claims_query(spark, tmp_path):
    rng = random.Random(3)
    said = [(s, t, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rng.randrange(4)) for _ in range(rng.randint(0, 15)))) for s in (1, 2) for t in range(12)]
    spark.createDataFrame(said, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["candidate_window_id"], r["i"], r["j"]): r["score"] for r in QUERIES["q2_near_claims"](spark, str(tmp_path)).collect()}
    want = {}
    for s, t, text in said:
        w = text.split()
        new = ["zqa" if i % 7 == t % 7 else (w[i + 1] if i + 1 < len(w) else x) if i % 5 == 1 else w[i - 1] if i % 5 == 2 else x for i, x in enumerate(w)]
        if len(new) >= 3:
            context = " ".join(x for a, b, x in said if a == s and x and b * 4000 <= (t * 4 + 11) * 1000 and b * 4000 + 4000 >= max(t * 4 - 5, 0) * 1000).split()
            want[f"{s}-{t}", 0, 0] = round(plain_support(new, context), 9)
    assert got == want and any(0.68 <= v < 1 for v in want.values()) and any(0 < v < 0.68 for v in want.values())


def plain_best(q, x, ids, d, k):
    u, v = x[:, :d] / np.linalg.norm(x[:, :d], axis=1, keepdims=True), q[:, :d] / np.linalg.norm(q[:, :d], axis=1, keepdims=True)
    s = np.round(np.clip(v @ u.T, -1, 1), 8)
    return [[(s[i, j], ids[j]) for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(q))]


@pytest.mark.parametrize("dims", [[64], [8, 16, 32, 64], [64, 5], [3]])
@pytest.mark.parametrize("queries", [1, 7, 90])
def test_prefixes_equal_each_dimension_by_itself(dims, queries):
    rng = np.random.default_rng(queries)
    x, q = rng.normal(size=(5000, 64)) * rng.random((5000, 1)), rng.normal(size=(queries, 64))
    x[::9] = q[0]
    ids = rng.permutation(5000)
    best = V.Prefixes(q, dims, 6)
    for at in range(0, 5000, 1300):
        best.hold(ids[at:at + 1300], x[at:at + 1300])
    for d in dims:
        s, i = best.best[d]
        assert [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in zip(s, i, strict=True)] == plain_best(q, x, ids, d, 6)


def test_rows_that_cannot_rank_are_passed_over():
    rng = np.random.default_rng(4)
    fade = 0.8 ** np.arange(64)  # most of a vector's length lies in its first components
    x, q = rng.normal(size=(20_000, 64)) * fade, rng.normal(size=(4, 64)) * fade
    best = V.Prefixes(q, [64], 5)
    best.hold(np.arange(20_000), x)
    s, i = best.best[64]
    assert [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in zip(s, i, strict=True)] == plain_best(q, x, np.arange(20_000), 64, 5)
    assert best.done < 0.6 * best.whole
    every = V.Prefixes(q, [64, 32, 16, 8], 5)
    every.hold(np.arange(20_000), x)
    assert every.done <= every.whole < 0.6 * 20_000 * 4 * (64 + 32 + 16 + 8)


def test_grounding_leaves_hopeless_windows_out(spark):
    segs = spark.createDataFrame([(1, e, e * 2000, e * 2000 + 2000, t) for e, t in enumerate(["the red fox ran over the hill", "a blue whale sang all night", "the red fox ran home again today"])], "stream_id long, event long, start_ms long, end_ms long, text string")
    cands = spark.createDataFrame([("a", 1, 0, 30, "the red fox ran over a hill", []), ("b", 1, 0, 30, "nothing of this was ever said", []), ("c", 1, 0, 30, "the red fox ran home. a blue whale sang", [])],
                                  "candidate_window_id string, stream_id long, start_seconds long, end_seconds long, transcript_excerpt string, transcript_evidence array<struct<timestamp:string,seconds:bigint,text:string>>")
    got = {r["candidate_window_id"]: (r["grounded"], [x["seconds"] for x in r["evidence"] or []]) for r in T.ground_evidence(cands, segs).collect()}
    assert got == {"a": (True, [0]), "b": (False, []), "c": (True, [4, 2])}


def test_few_windows_are_measured(monkeypatch):
    """Windows bounded by their longest common subsequence are passed over; the best of all windows stays."""
    import difflib
    import random

    from vodmill.operators import captions as T

    rng, calls, matcher = random.Random(8), [0], difflib.SequenceMatcher

    def counted(*a, **k):
        calls[0] += 1
        return matcher(*a, **k)

    def plain(claim, context):
        n, best = len(claim), 0.0
        for width in (n, n + max(3, min(12, n // 2))):
            for i in range(len(context)):
                w = context[i:i + width]
                shared = sum(min(claim.count(x), w.count(x)) for x in {*claim})
                if shared:
                    best = max(best, 0.65 * matcher(None, claim, w, autojunk=False).ratio() + 0.35 * shared / n)
        return best

    monkeypatch.setattr(T.difflib, "SequenceMatcher", counted)
    windows = 0
    for _ in range(40):
        context = [f"w{rng.randrange(60)}" for _ in range(150)]
        at, n = rng.randrange(120), rng.randrange(3, 25)
        claim = ["zqa" if i % 7 == 3 else w for i, w in enumerate(context[at:at + n])]
        for i in range(1, len(claim) - 1, 5):
            claim[i], claim[i + 1] = claim[i + 1], claim[i]
        assert T.score_support(claim, context) == plain(claim, context)
        windows += 1
    assert calls[0] < 5 * windows, calls[0] / windows
