import numpy as np
import pytest

from interlock.llm.boosting import Boosted
from interlock.llm.candidates import KINDS, Names
from interlock.llm.labelled import sentences
from interlock.llm.personal import common_words, detect, models, personal_spans, redact, replaced


def test_boosting_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) & (x[:, 2] < 0.5)).astype(float)
    m = Boosted().fit(x[:2000], y[:2000]).calibrate(x[2000:2500], y[2000:2500])
    assert ((m.predict(x[2500:]) >= m.threshold) == (y[2500:] > 0)).mean() > 0.98


def test_held_out_accuracy():
    texts, names = sentences(seed=77, number=1200, common=common_words())
    for kind, (recall, precision) in accuracy(texts, names, models()).items():
        assert recall >= 0.93 and precision >= 0.95, kind


def accuracy(texts, names, fitted):
    got, out = detect([t for t, _ in texts], names, fitted), {}
    for kind in KINDS:
        true = {(i, s) for i, (_, spans) in enumerate(texts) for k, s in spans if k == kind}
        found = {(i, s) for i, spans in enumerate(got) for k, s, _ in spans if k == kind}
        out[kind] = len(true & found) / len(true), len(true & found) / max(1, len(found))
    return out


def test_sentence_patterns_kept_out_whole():
    texts, names = sentences(seed=77, number=1200, common=common_words(), held=True)
    for kind, (recall, precision) in accuracy(texts, names, models(kept_out=True)).items():
        assert recall >= (0.85 if kind == "name" else 0.95) and precision >= 0.85, (kind, recall, precision)


def test_names_no_list_knows_and_endings_of_any_kind():
    cases = {
        "contact Priya Ramanathan": [("name", 8)], "Thanks, Mohammed Al-Rashid": [("name", 8)], 'operator "Oluwaseun Adeyemi" confirmed': [("name", 10)], "联系人:王小明": [("name", 4)], "Иван Петров": [("name", 0)], "María del Carmen López García": [("name", 0)],
        "jane@corp.museum": [("email", 0)], "write to jane.doe at corp dot photography": [("email", 9)], "look at the dot matrix printer": [], "由于光线不足": [], "Gaussian Blur and Edge Map are off. The Side Matcher works.": [], "THE EDGE MAP IS OFF TODAY": [],
    }
    found = detect(list(cases), Names({"Nessa"}, {"Lindovik"}, common_words()), models())
    assert {t: [(k, a) for k, a, _ in spans] for t, spans in zip(cases, found)} == cases


PEOPLE = [(1, "Nessa", "Lindovik", None), (2, "Tobin", "Golmarwen-Braskoholt", "t"), (3, None, None, None)]


@pytest.fixture
def tables(spark):
    people = spark.createDataFrame(PEOPLE, "contributor_id long, given_name string, family_name string, handle string")
    rows = [
        (1, "Ask Nessa Lindovik <nessa.l@example.org>, tel +44 20 7946 0123."),
        (2, "Write to tobin [at] example [dot] org or 12 Mill Lane; Passport X1234567 was noted."),
        (3, "See row 123-45-6789 of the log. Handle @tabfinder is taken. err@0.5"),
        (4, None),
        (5, ""),
        (6, "   \n"),
        (7, "0" * 200_000 + " 👩‍🔧 tel 020 7946 0123"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as kind", "1 as id")
    return docs, people


def test_spans(tables):
    got = {(r["doc_id"], r["kind"], r["start_pos"]) for r in personal_spans(*tables).collect()}
    assert got == {
        (1, "name", 4), (1, "email", 20), (1, "phone", 46), (2, "email", 9), (2, "address", 41), (2, "id_number", 64), (7, "phone", 200_009),
    }


def test_redaction_keeps_all_else(tables):
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in redact(*tables).collect()}
    assert got[1] == ("Ask [NAME] <[EMAIL]>, tel [PHONE].", 3)
    assert got[3] == ("See row 123-45-6789 of the log. Handle @tabfinder is taken. err@0.5", 0)
    assert got[4] == (None, 0) and got[5] == ("", 0) and got[6] == ("   \n", 0)
    assert replaced("abc", []) == "abc"


def test_empty_tables(tables, spark):
    docs, people = tables
    assert personal_spans(docs.limit(0), people).count() == 0
    assert personal_spans(docs, people.limit(0)).where("kind = 'phone'").count() == 2
    assert detect([None, ""], Names(set(), set()), models()) == [[], []]
