import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lineside.llm import language, toxicity
from lineside.llm.tables import held_out
from tests.llm.conftest import prose

STOCK = {"en": "the of and to house water light green", "de": "der die und das haus wasser licht grün", "fr": "le la et les maison eau verte été"}


def test_held_out_fold(documents):
    got = documents([(i, "a") for i in range(200)] + [(None, "a")]).select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_language(documents, odd_rows):
    rng = random.Random(5)
    rows = [(100 + i, " ".join(rng.choice(STOCK[lang].split()) for _ in range(30)), lang) for i in range(150) for lang in [rng.choice(list(STOCK))]]
    rows += [(900, "1234 !!", "en"), (901, None, "de"), (902, "", None), (903, "hausung wasserlich", None), (904, "²½", "fr")]
    got = {(r.doc_id, r.lang_pred, r.held_out): r.score for r in language.identify(documents(rows)).collect()}
    by = {k[0]: k[1] for k in got}
    assert len(by) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all(by[d] == lang for d, _, lang in rows if d < 900)
    assert by[900] == by[901] == by[902] == by[904] == "und"
    assert by[903] == "de"  # unseen words, by their n-grams
    assert language.identify(documents(odd_rows)).count() == len(odd_rows)
    assert language.identify(documents([])).count() == 0


def test_backoff_takes_the_longest_known_gram():
    model = language.Model(["a", "b"], [{"word": 0}, {"x": 1}, {}, {"rdx": 2, "dx>": 3}, {}], np.array([[1.0, 2.0], [9, 0], [0, 5], [0, 7]]))
    assert model.scores(["word", "wordx", "q", "x"]).tolist() == [[1, 2], [0, 6], [0, 0], [9, 0]]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark, documents, odd_rows):
    rng = random.Random(6)
    rows, labels = list(odd_rows), [(4, 1, 0), (4, 1, 0), (9999, 1, 1)]
    for i in range(300):
        text = prose(rng, 40, 150)
        if i % 4 == 0:
            text += " you scumlord" + rng.choice(["s", "ish", "y"])
        rows.append((100 + i, text))
        labels.append((100 + i, 1, int(i % 4 == 0)))
    got = {r.doc_id: r for r in toxicity.toxicity(documents(rows), labelled(spark, labels)).collect()}
    assert all(got[100 + i].predicted == int(i % 4 == 0) for i in range(300))
    assert got[1].score == got[2].score and got[1].predicted == 0
    kept = toxicity.drop_toxic(documents(rows), labelled(spark, labels))
    assert kept.columns == documents(rows).columns
    assert kept.where(F.col("doc_id") >= 100).count() == 225
    assert toxicity.toxicity(documents(rows[:5]), labelled(spark, [])).where("predicted = 1").count() == 0
    assert toxicity.toxicity(documents([]), labelled(spark, labels)).count() == 0


def test_swapped_twins_hold_the_identity_weight_down():
    # "muslims" is toxic in the sample more often than not; its twins carry the same label.
    index = {"muslims": 0, "insult": 1, "christians": 2}
    rows = [np.array([0, 1])] * 20 + [np.array([0])] * 2 + [np.array([], int)] * 40
    labels = np.array([1.0] * 20 + [1, 0] + [0.0] * 40)
    twins = [(i, np.array([2 if x == 0 else x for x in rows[i]])) for i in range(22)]
    free, _ = toxicity.fit_weights(rows, [], labels, 3)
    held, _ = toxicity.fit_weights(rows, twins, labels, 3, fairness=20.0)
    gap = lambda w: abs(w[index["muslims"]] - w[index["christians"]])
    assert gap(held) < 0.35 * gap(free)


def test_swapping_replaces_every_term():
    found = toxicity.swapped(toxicity.features("the muslims met"), 0)
    assert "christians" in found and "muslims" not in found and "chris*" in found and "musli*" not in found
