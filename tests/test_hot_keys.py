"""Hot-key paths must give what the ordinary paths give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studylake.operators import exam as X
from studylake.operators import ops as O
from studylake.operators import progress as P
from studylake.operators import retrieval as V
from studylake.operators import sessions as S
from studylake.operators.throttle import throttle
from studylake.sources.tables import load, view
from tests.conftest import rows


@pytest.fixture(scope="module")
def answers(spark, sf):
    """Answers where one learner holds about a third of all rows."""
    a = view(spark, sf, "answers")
    return a.withColumn("learner_id", F.when(F.col("answer_id") % 3 == 0, 7).otherwise(F.col("learner_id"))).cache()


@pytest.fixture(scope="module")
def gaps(answers):
    """The same with nulls in every key and in the time, and a crowded null learner."""
    i = F.col("answer_id")
    return answers.withColumns({
        "learner_id": F.when(i % 7 == 2, None).otherwise(F.col("learner_id")), "kp_id": F.when(i % 4 == 1, None).otherwise(F.col("kp_id")),
        "question": F.when(i % 5 == 3, None).otherwise(F.col("question")), "ts": F.when(i % 97 == 5, None).otherwise(F.col("ts")),
    }).cache()


HOT = 40  # the crowded learner, and some others, count as hot


@pytest.mark.parametrize(
    "operator",
    [P.running_levels, P.answer_runs, P.adaptive_action, P.hint_level, P.achievements, P.review_history,
     P.practice_trigger, P.exam_trigger, P.fatigue_flag],
)
def test_sliced_equals_plain(answers, operator):
    assert answers.filter("learner_id = 7").count() > HOT
    plain, sliced = operator(answers, hot_rows=10**9), operator(answers, hot_rows=HOT)
    assert rows(sliced) == rows(plain)
    assert rows(sliced)


@pytest.mark.parametrize("operator", [P.running_levels, P.answer_runs, P.adaptive_action, P.hint_level, P.achievements, P.review_history, P.fatigue_flag])
def test_nulls_do_not_depend_on_size(gaps, operator):
    assert gaps.filter("learner_id IS NULL").count() > HOT
    plain, sliced = operator(gaps, hot_rows=10**9), operator(gaps, hot_rows=HOT)
    assert rows(sliced) == rows(plain) and rows(sliced)


def test_throttle_takes_null_as_a_key(spark):
    big = 2**60
    events = [(k, 5 * i, 10 * i + n) for i in range(60) for n, k in enumerate((None, big, big + 1))] + [(None, None, 999)]
    df = spark.createDataFrame(events, "k long, at long, id long")
    want = greedy([(-1 if k is None else k, at, i) for k, at, i in events if at is not None], 17, False)
    for kwargs in ({}, {"sliced": True}, {"sliced": True, "slice_width": 17}):
        got = sorted((-1 if r.k is None else r.k, r["at"], r.id) for r in throttle(df, ["k"], "at", "id", 17, **kwargs).collect())
        assert got == want, kwargs


def test_consecutive_practice(answers):
    plain, sliced = (P.practice_trigger(answers, consecutive=True, hot_rows=h) for h in (10**9, HOT))
    assert rows(plain) == rows(sliced)
    runs = P.answer_runs(answers).filter("score < 0.5 AND consecutive_wrong >= 2").select("answer_id")
    assert plain.join(runs, "answer_id", "left_anti").count() == 0 and plain.count() > 0


def test_task_progress_sliced(spark, sf):
    reports = load(spark, sf, "events").selectExpr(
        "event_id AS report_id", "user_id % 3 AS task_id", "event_id * 50 AS at_s", "(event_id * 7) % 31 AS current_question",
        "(event_id * 11) % 17 AS correct_count", "(event_id * 5) % 23 AS wrong_count",
    )
    assert rows(P.task_progress(reports, hot_rows=10)) == rows(P.task_progress(reports, hot_rows=10**9))


def test_outages_sliced(spark, sf):
    calls = view(spark, sf, "backend_calls").withColumn("at_s", F.col("at_s") * 100)
    assert rows(O.outage_windows(calls, hot_rows=10)) == rows(O.outage_windows(calls, hot_rows=10**9))


def test_book_progress_sliced(spark, sf):
    events = view(spark, sf, "book_events")
    plain = rows(O.book_progress(events, hot_rows=10**9))
    assert rows(O.book_progress(events, per_slice=7, hot_rows=3)) == plain
    assert len({r[1] for r in O.book_progress(events).select("book_id", "state").collect()}) >= 3


def test_structure_blocks_sliced(spark):
    lines = [(1, i, i // 40, "image" if i % 7 == 6 else "text", f"{i}. ask" if i % 5 == 2 else f"A. opt{i}" if i % 5 == 3 else f"line {i}")
             for i in range(4000)]
    blocks = spark.createDataFrame(lines, "doc_id long, pos long, page long, type string, text string")
    assert rows(X.structure_blocks(blocks, hot_rows=10)) == rows(X.structure_blocks(blocks, hot_rows=10**9))


def greedy(events, gap, strict):
    last, out = {}, []
    for key, at, eid in sorted(events):
        if key not in last or (at - last[key] > gap if strict else at - last[key] >= gap):
            last[key] = at
            out.append((key, at, eid))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("strict", [False, True])
def test_throttle_forms_agree_with_brute_force(spark, seed, strict):
    rng = random.Random(seed)
    span, gap = rng.choice([(300, 7), (5000, 40), (100000, 900)]), None
    span, gap = span
    events = [(rng.choice([1, 1, 2, 3]), rng.randrange(span), i) for i in range(2500)]
    df = spark.createDataFrame(events, "k long, at long, id long")
    want = greedy(events, gap, strict)
    for kwargs in ({}, {"sliced": True}, {"sliced": True, "slice_width": gap}, {"sliced": True, "slice_width": 5 * gap}):
        got = sorted((r.k, r["at"], r.id) for r in throttle(df, ["k"], "at", "id", gap, strict=strict, **kwargs).collect())
        assert got == want, kwargs


def test_guards_against_brute_force(spark):
    rng = random.Random(5)
    tries = [(i, rng.choice([1, 1, 2]), rng.randrange(20000), rng.choice(["a", "B ", "b", "", "c"]), rng.choice(["x", "y"])) for i in range(4000)]
    df = spark.createDataFrame(tries, "attempt_id long, learner_id long, at_s long, title string, source string")
    states, want = {}, []
    for i, learner, at, title, source in sorted(tries, key=lambda t: (t[1], t[2], t[0])):
        last, live = states.get(learner, (None, []))
        live = [s for s in live if at <= s[0] + 1500]
        name = title.strip().lower()
        ok = (last is None or at - last >= 30) and len(live) < 5 and not (
            name and any(t == name and s == source and at - c < 300 for c, t, s in live)
        )
        if ok:
            last, live = at, [*live, (at, name, source)]
            want.append(i)
        states[learner] = (last, live)
    got = [r.attempt_id for r in S.guarded_sessions(df, ttl_s=1500).collect()]
    assert sorted(got) == sorted(want)


def test_guards_bypassed_and_places_freed(spark):
    """Five pending sessions close the guard; an explicit wish passes it, a session that is taken up frees a place."""
    rows = [(i, 1, 100 * i, f"t{i}", "s", False, None) for i in range(5)] + [
        (5, 1, 500, "t5", "s", False, None), (6, 1, 501, "t0", "s", True, None), (7, 1, 505, "t7", "s", True, 600), (8, 1, 540, "t8", "s", False, None),
        (9, 2, 0, "t", "s", False, 50), (10, 2, 40, "t", "s", False, None), (11, 2, 60, "t", "s", False, None),
    ]
    df = spark.createDataFrame(rows, "attempt_id long, learner_id long, at_s long, title string, source string, bypass boolean, left_s long")
    assert {r.attempt_id for r in S.guarded_sessions(df, 10_000).collect()} == {0, 1, 2, 3, 4, 6, 7, 9, 11}


def test_guards_keep_null_and_large_ids_apart(spark):
    big = 2**53
    cases = [(i, who, at, "t", "s") for i, (who, at) in enumerate([(None, 0), (None, 1), (None, 4), (None, 40), (big, 0), (big + 1, 1), (big + 1, 5), (big, 700)])]
    df = spark.createDataFrame([*cases, (99, 1, None, "t", "s")], "attempt_id long, learner_id long, at_s long, title string, source string")
    got = {(r.attempt_id, r.learner_id) for r in S.guarded_sessions(df.repartition(3)).collect()}
    assert got == {(0, None), (4, big), (5, big + 1), (7, big)}


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "ip"])
def test_topk_forms_agree_with_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(700, 8))
    vec[100:200] = vec[0]  # many equal copies: ties go to the smaller id
    ask = rng.normal(size=(9, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vec)], "chunk_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(ask)], "query_id long, embedding array<double>")
    if metric == "l2sq":
        d = ((ask[:, None] - vec[None]) ** 2).sum(2)
    elif metric == "ip":
        d = 1 - ask @ vec.T
    else:
        d = 1 - (ask @ vec.T) / (np.linalg.norm(ask, axis=1)[:, None] * np.linalg.norm(vec, axis=1)[None])
    want = sorted((i, int(j)) for i in range(9) for j in sorted(range(700), key=lambda j: (round(d[i, j], 9), j))[:6])
    for df in (V.vector_topk(q, v, 6, metric), V.blocked_topk(q, v, 6, metric, query_block=4, vector_block=100),
               V.vector_topk(q, v, 6, metric, max_queries=3)):
        assert sorted((r.query_id, r.chunk_id) for r in df.collect()) == want


def test_topk_within_a_subject(spark):
    rng = np.random.default_rng(4)
    vec, ask = rng.normal(size=(300, 4)), rng.normal(size=(4, 4))
    v = spark.createDataFrame([(i, x.tolist(), f"s{i % 7}") for i, x in enumerate(vec)], "chunk_id long, embedding array<double>, subject string")
    q = spark.createDataFrame([(i, x.tolist(), f"s{i * 3}") for i, x in enumerate(ask)], "query_id long, embedding array<double>, subject string")
    d = ((ask[:, None] - vec[None]) ** 2).sum(2)
    want = sorted((i, j) for i in range(4) for j in sorted((j for j in range(300) if j % 7 == i * 3), key=lambda j: d[i, j])[:5])
    assert len(want) == 15  # nothing for the subject no vector has
    for limit in (100, 1):
        got = V.vector_topk(q, v, 5, max_queries=limit, within="subject").collect()
        assert sorted((r.query_id, r.chunk_id) for r in got) == want


def test_ann_is_a_subset_with_good_recall(spark, sf):
    e = load(spark, sf, "embeddings")
    q, v = V.profile_vectors(e), e.select(F.col("vec_id").alias("chunk_id"), "embedding")
    got = V.recall(V.vector_topk_ann(q, v, 10), V.vector_topk(q, v, 10)).agg(F.sum("k"), F.sum("found")).first()
    assert got[1] / got[0] > 0.5
    assert rows(V.vector_topk_ann(q, v, 10, max_queries=3)) == rows(V.vector_topk_ann(q, v, 10))
