"""Rules with nulls, white space, ties and failing rows, against plain Python."""

import statistics

import numpy as np
import pandas as pd
import pytest

from corpuslens.functions import text as TX
from corpuslens.operators import metrics as M
from corpuslens.operators import normalize as N
from corpuslens.operators import pairs as PA
from corpuslens.operators import sampling as S
from corpuslens.operators import scoring as SC
from corpuslens.operators import trainlog as T
from corpuslens.session import private_folder

SPACES = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0", "\u1680", "\u2000", "\u200a",
          "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
TEXTS = [f"{s}a{s}{s}b c{s}" for s in SPACES] + ["", " ", "\u200b zero width \u200b", "x\u00a0\u3000y"]


def test_words_and_strip_follow_python(spark, duck):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: (list(r.w), r.s) for r in df.select("i", TX.words("t").alias("w"), TX.pystrip("t").alias("s")).collect()}
    assert got == {i: (t.split(), t.strip()) for i, t in enumerate(TEXTS)}
    con = duck("/root/testdata/sf0.001")
    for t in TEXTS:
        w, s = con.execute(f"SELECT {TX.words_sql('t')}, {TX.pystrip_sql('t')} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()
        assert (w, s) == (t.split(), t.strip())


def test_encode_label_of_null_is_0(spark):
    df = spark.createDataFrame([("sarc",), ("other",), (None,)], "c string")
    assert [r[0] for r in df.select(N.encode_label("c")).collect()] == [1, 0, 0]


def classes(spark):
    rows = [(i, "a" if i % 10 < 5 else "b" if i % 10 < 8 else None) for i in range(1000)]
    return spark.createDataFrame(rows, "doc_id long, class string")


def test_a_null_class_is_split_like_any_other(spark):
    for split in (S.split_per_class(classes(spark), "class", "doc_id", 42, 0.8),
                  S.split_stratified(classes(spark), "class", "doc_id", 42, test_size=0.2)):
        got = {(r["class"], r.split): r["count"] for r in split.groupBy("class", "split").count().collect()}
        assert got == {("a", "train"): 400, ("a", "test"): 100, ("b", "train"): 240, ("b", "test"): 60, (None, "train"): 160, (None, "test"): 40}


def test_balancing_leaves_rows_without_a_class_out(spark):
    for sample, n in ((S.balance_to_minority(classes(spark), "class", "doc_id", 2000), 300), (S.sample_balanced(classes(spark), "class", "doc_id", 500), 250)):
        assert {r["class"]: r["count"] for r in sample.groupBy("class").count().collect()} == {"a": n, "b": n}


def test_ordinal_split_with_an_outlier(spark):
    df = spark.createDataFrame([(i,) for i in range(999)] + [(10**15,)], "x long")
    got = S.split_ordinal(df, "x", 0.9)
    assert sorted(r.x for r in got.where("split = 'train'").collect()) == list(range(900)) and got.count() == 1000


LOG = [(run, step, float(((step or 0) * 37 + (run or 5)) % 11)) for run in (1, None) for step in (*range(30), 10**9, None)]


def test_rolling_drift_keeps_null_runs_and_steps(spark):
    df = spark.createDataFrame(LOG, "run long, step long, chosen_mean double")
    got = {(r.run, r.step): r.drift for r in T.rolling_drift(df).collect()}
    assert len(got) == len(LOG)
    for run in (1, None):
        rows = sorted(((s is not None, s or 0), s, v) for r, s, v in LOG if r == run)  # null steps first
        for i, (_, step, _) in enumerate(rows):
            last = [v for _, _, v in rows[max(0, i - 9): i + 1]]
            assert got[run, step] == pytest.approx(statistics.pstdev(last))


def test_running_best_keeps_null_runs(spark):
    df = spark.createDataFrame([(r, e, v) for r, e, v in LOG if e is not None], "run long, epoch long, eval_f1 double")
    got = {(r.run, r.epoch): r.best_before for r in T.running_best(df).collect()}
    for run in (1, None):
        best = 0.0
        for _, e, v in sorted(((e, e, v) for r, e, v in LOG if r == run and e is not None)):
            assert got[run, e] == best
            best = max(best, v)


def test_confusion_normalized_has_four_cells(spark):
    df = spark.createDataFrame([("m", 1, 1), ("m", 1, 1), ("m", 1, 0), ("m", 1, -1), ("m", 0, -1)], "model string, label int, pred int")
    got = {(r.label, r.pred): (r.n, r.pct) for r in M.confusion_normalized(df).collect()}
    assert got == {(0, 0): (0, 0.0), (0, 1): (0, 0.0), (1, 0): (1, pytest.approx(100 / 3)), (1, 1): (2, pytest.approx(200 / 3))}


def test_a_raising_scorer_loses_only_its_row(spark):
    def factory():
        def score(texts):
            if texts.str.contains("bad").any():
                raise ValueError("cannot score")
            return pd.DataFrame({"reply": ["Yes"] * len(texts), "p_yes": [0.75] * len(texts), "p_no": [0.25] * len(texts)})
        return score

    df = spark.createDataFrame([(i, "bad text" if i % 7 == 3 else "text") for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: (r.reply, r.p_yes, r.error) for r in SC.score_batches(df, scorer_factory=factory).collect()}
    assert got == {i: (None, None, "ValueError: cannot score") if i % 7 == 3 else ("Yes", 0.75, None) for i in range(40)}
    assert SC.score_batches(df.limit(0), scorer_factory=factory).collect() == []


def test_a_row_that_raises_does_not_send_its_batch_row_by_row():
    calls = []

    def scorer(texts):
        calls.append(len(texts))
        if (texts == "bad").any():
            raise ValueError("bad text")
        return pd.DataFrame({"reply": texts, "p_yes": 1.0, "p_no": 0.0})

    texts = pd.Series([f"t{i}" for i in range(2000)])
    bad = [0, 700, 701, 1999]
    texts[bad] = "bad"
    got = SC._scored(scorer, texts)
    assert list(got.index) == list(range(2000)) and len(calls) < 100
    assert list(np.flatnonzero(got["error"] == "ValueError: bad text")) == bad
    assert list(np.flatnonzero(got["reply"] != texts)) == bad and list(np.flatnonzero(got["p_yes"].isna())) == bad
    every = SC._scored(scorer, pd.Series(["bad"] * 5))
    assert list(every["error"]) == ["ValueError: bad text"] * 5 and every["reply"].isna().all()


def test_many_rows_that_raise_cost_little_more_than_row_by_row():
    calls = []

    def scorer(texts):
        calls.append(len(texts))
        if (texts == "bad").any():
            raise ValueError("bad text")
        return pd.DataFrame({"reply": texts, "p_yes": 1.0, "p_no": 0.0})

    texts = pd.Series(["bad" if i % 2 else f"t{i}" for i in range(2000)])
    got = SC._scored(scorer, texts)
    assert len(calls) <= 1.6 * len(texts)
    assert list(got["reply"][::2]) == list(texts[::2]) and got["error"][::2].isna().all()
    assert (got["error"][1::2] == "ValueError: bad text").all() and got["reply"][1::2].isna().all()


def test_lexical_scorer_counts_as_pandas_does():
    rng = np.random.default_rng(0)
    bits = [*SC.SCORER_CUES, "OH", "a", "!!", "\u00a0", "\n", " ", " x ", "\x1c", "é"]
    texts = pd.Series(["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(300)] + [None, ""], dtype=object)
    got = SC.lexical_scorer()(texts)
    low = texts.fillna("").str.lower()
    want = (sum(low.str.count(c) for c in SC.SCORER_CUES) / low.str.split().str.len().clip(lower=1) * 10).clip(upper=1.0)
    assert list(got["p_yes"]) == list(want) and list(got["p_no"]) == list(1.0 - want)
    assert list(got["reply"]) == ["Yes" if p >= 0.5 else "No" for p in want]


def test_lexical_score_as_columns_equals_the_batched_one(spark):
    df = spark.createDataFrame([(0, "Oh great, sure!"), (1, None), (2, ""), (3, "wow\u00a0yeah plain words here")], "doc_id long, text string")
    a, b = ({r.doc_id: (r.reply, r.p_yes, r.p_no) for r in f(df).collect()} for f in (SC.score_lexical, SC.score_batches))
    assert a == b


def test_vocabulary_of_words_with_one_prefix(spark):
    df = spark.createDataFrame([(i, f"http{i:05d} b{'' if i % 2 else ' a'}") for i in range(3000)], "doc_id long, text string")
    ids = {r.word: r.id for r in PA.build_vocabulary(df).collect()}
    want = ["b", "a"] + [f"http{i:05d}" for i in range(3000)]
    assert ids == {w: i + 2 for i, w in enumerate(want)}


def test_a_cluster_without_a_shared_folder_raises():
    with pytest.raises(RuntimeError):
        private_folder("spark://host:7077")
    assert private_folder("local[2]")


def test_pairs_need_both_models(spark):
    from corpuslens.operators.pairing import pair_models
    rows = [("x", 1, 1, 1), ("y", 1, 1, 0), ("x", 2, 0, None), ("y", 2, 0, 0), ("x", 3, 1, 1), ("z", 3, 1, 1)]
    df = spark.createDataFrame(rows, "model string, doc_id long, label int, pred int")
    got = sorted(tuple(r) for r in pair_models(df, "x", "y").select("doc_id", "label", "x_pred", "y_pred", "x_correct", "y_correct").collect())
    assert got == [(1, 1, 1, 0, True, False), (2, 0, None, 0, None, True)]


def test_absent_inputs_are_reported(spark):
    from corpuslens.sources.io import source_inventory
    got = {r.table_name: (r.present, r.rows) for r in source_inventory(spark, {
        "labels": "/root/testdata/sf0.001/labels.parquet", "gone": "/root/testdata/sf0.001/gone.parquet"}).collect()}
    assert got["gone"] == (False, None) and got["labels"][0] is True


def test_word_counts_and_first_words_follow_python(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "i int, t string")
    got = {r.i: (r.n, r.w) for r in df.select("i", TX.word_count("t").alias("n"), TX.first_words("t", 2).alias("w")).collect()}
    assert got.pop(99) == (None, None)
    assert got == {i: (len(t.split()), t.split()[:2]) for i, t in enumerate(TEXTS)}


def test_encoding_has_a_row_for_every_row(spark):
    rows = [(1, "a b a"), (1, "b c"), (None, "a"), (None, None), (2, ""), (3, " \n"), (4, "a " * 300), (4, "a " * 300), (5, "long" * 40 + " a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3), ("long" * 40, 50_000)], "word string, id long")
    got = PA.encode_fixed_length(docs, vocab, max_length=8).collect()
    ids = {"a": 2, "b": 3, "long" * 40: 50_000}

    def plain(text):
        w = [ids.get(x, PA.UNK_ID) for x in (text or "").lower().split()[:8]]
        return w + [PA.PAD_ID] * (8 - len(w)), [1] * len(w) + [0] * (8 - len(w))

    assert sorted(map(str, [(r.doc_id, (r.input_ids, r.attention_mask)) for r in got])) == sorted(map(str, [(i, plain(t)) for i, t in rows]))


def test_epoch_losses_as_of_the_end_step(spark):
    """Against plain Python: a run with thousands of epochs, ties, nulls, entries on both sides of every range."""
    import random

    rng = random.Random(3)
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, rng.randrange(5000), rng.randrange(5000)]),
                rng.choice([None, rng.random(), rng.random()])) for _ in range(4000)]
        log += [("late", 4000, 0.5), ("hot", 77, 0.1), ("hot", 77, 0.9)]
        epochs = [(rng.choice(["hot", "hot", "b", None, "late", "none"]), i, rng.choice([None, *[rng.randrange(5000)] * 9]), "x") for i in range(3000)]
        got = T.epoch_metrics(spark.createDataFrame(epochs, "run string, epoch int, end_step long, other string"),
                              spark.createDataFrame(log, "run string, step long, loss double"))
        assert got.columns == ["run", "epoch", "end_step", "other", "train_loss"]
        want = []
        for run, epoch, end, other in epochs:
            before = [(s, v) for r, s, v in log if r == run and s is not None and v is not None and end is not None and s <= end]
            want.append((run, epoch, end, other, max(before)[1] if before else 0.0))
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)


def test_describe_keeps_the_quartiles_of_a_null_group(spark):
    from corpuslens.operators import profile as PF

    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    got = {r.g: (r["count"], r.p50) for r in PF.describe(df, "v", ["g"]).collect()}
    assert got == {None: (2, 2.0), "a": (1, 2.0)}
