from collections import Counter

from pyspark.sql import functions as F

from helpers import AWKWARD, documents
from twinloom.llm import language
from twinloom.llm.language import UNKNOWN, identify, learn_profiles
from twinloom.llm.queries import op1_language_id

FOLDER = "/root/testdata/sf0.01"


def grams(text):
    out = Counter()
    for word in "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split():
        padded = f" {word} "
        out.update(word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def number(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def single_blanks(text):
    """A blank between two words belongs to both; n-grams over it are not counted."""
    return Counter({number(g): n for g, n in grams(text).items()})


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def test_profiles(spark):
    rows = [(1, "Über die Brücke, don't!", "de"), (2, "the the cat\nsat", "en"), (3, None, "en"), (4, "x", None)]
    found = {}
    for r in learn_profiles(documents(spark, rows, clashes=True), size=10).orderBy("lang", "rank").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    assert found == {lang: ranked(single_blanks(t), 10) for _, t, lang in rows[:2]}


def test_prediction_is_nearest_profile(spark, monkeypatch):
    texts = {"de": "der die das und nicht ist ein zu " * 5, "en": "the of and to in is that for it was " * 5}
    learned = learn_profiles(documents(spark, [(i, t, lang) for i, (lang, t) in enumerate(texts.items())]))
    profiles = {lang: ranked(single_blanks(t), language.PROFILE) for lang, t in texts.items()}
    asked = ["und das ist nicht der", "that was the end of it", "zzz qqq", "12 34", "", None]
    found = identify(documents(spark, [(i, t) for i, t in enumerate(asked)], clashes=True), learned)
    for row in found.collect():
        text = asked[row["doc_id"]]
        if not text or not any(c.isalpha() for c in text):
            assert (row["lang_pred"], row["score"]) == (UNKNOWN, 0.0)
            continue
        own = ranked(single_blanks(text), language.PROFILE)
        far = {}
        for lang, profile in profiles.items():
            places = {g: i for i, g in enumerate(profile)}
            far[lang] = sum(abs(i - places[g]) if g in places else language.PROFILE for i, g in enumerate(own))
        best = min(far, key=lambda lang: (far[lang], lang))
        assert row["lang_pred"] == best
        assert abs(row["score"] - (1 - far[best] / (language.PROFILE * len(own)))) < 1e-9


def test_long_text_in_chunks(monkeypatch):
    text = "Der schnelle Fuchs springt über den faulen Hund " * 200
    want = language.ranked_ngrams(text).tolist()
    monkeypatch.setattr(language, "CHUNK", 100)
    assert language.ranked_ngrams(text).tolist() == want


def test_flushes_change_nothing(spark, monkeypatch):
    docs = documents(spark, [(i, f"word{i} the cat", "en") for i in range(50)])
    want = sorted(map(tuple, learn_profiles(docs).collect()))
    monkeypatch.setattr(language, "HELD_WORDS", 2)
    assert sorted(map(tuple, learn_profiles(docs).collect())) == want


def test_awkward(spark):
    learned = learn_profiles(documents(spark, AWKWARD))
    assert identify(documents(spark, AWKWARD, clashes=True), learned).count() == len(AWKWARD)
    nothing = learn_profiles(documents(spark, []))
    assert {r["lang_pred"] for r in identify(documents(spark, AWKWARD), nothing).collect()} == {UNKNOWN}
    assert identify(documents(spark, []), learned).count() == 0


def test_held_out_accuracy(spark):
    found = op1_language_id(spark, FOLDER).where("held_out")
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    both = found.join(truth, "doc_id")
    total, right = both.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert total > 200 and right >= 0.98 * total
    assert both.where("score < 0 or score > 1").count() == 0
