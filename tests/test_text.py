import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinloom.functions import languages, text
from twinloom.functions.keyed import hash32, hash60

SAMPLES = [
    "plain",
    "a ( b ) , c . d",
    "( x ) . ( y )",
    "„low“ “high” ‘a’ ‚b’ it’s x‘y",
    "dash – and — long",
    "«\u00a0quoted\u00a0» «bare» « x »",
    "5 %  6\u00a0% nº\u00a07 8\u00a0ºC 9\u00a0cm a\u00a0: b\u00a0; c\u00a0? d\u00a0! e,\u00a0f",
    "1\u00a0000\u00a0000",
    'said "hello", then "bye".',
    "``tick'' ´acute´ …",
    "line\r\nbreak\ttab",
    "  \u00a0 padded \u3000",
    "Римдин аскерар ва гьакӀни чӀехи хахамрини.",
    "٣ % arabic digit",
    "",
]


def moses(line: str, lang: str = "en") -> str:
    """The same rules restated with Python's re, every blank run rewritten."""
    for rule in text.punct_rules(lang):
        pattern = rule.find if rule.regex else re.escape(rule.find)
        pattern = pattern.replace(" {2,}", " +").replace(r"\p{Nd}", r"\d")
        put = re.sub(r"\$(\d)", r"\\g<\1>", rule.put) if rule.regex else rule.put.replace("\\", r"\\")
        line = re.sub(pattern, put, line)
    return line.strip()


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


@pytest.mark.parametrize("lang", ["en", "de", "cs", "ru"])
def test_punct_rules_agree_with_python(spark, lang):
    got = column(spark, SAMPLES, lambda c: text.normalize_punct(c, lang))
    assert got == [moses(s, lang) for s in SAMPLES]


def test_punct_by_hand(spark):
    cases = {
        "a ( b ) , c": "a (b), c",
        "“x”…": '"x..."',
        "5 %": "5%",
        "1\u00a0000": "1.000",
        'end",': 'end,"',
        "x — y": "x - y",
    }
    assert column(spark, list(cases), text.normalize_punct) == list(cases.values())


def test_nonprint_follows_categories(spark):
    chars = ["\t", "\n", "\u00ad", "\ufeff", "\u200b", "\ue000", "a", "Ӏ", "é", "\U0001f600", "\u0378"]
    got = column(spark, [f"x{c}y" for c in chars], text.replace_nonprint)
    want = ["x y" if unicodedata.category(c).startswith("C") else f"x{c}y" for c in chars]
    assert got == want
    assert column(spark, ["a\tb"], lambda c: text.replace_nonprint(c, "$1\\")) == ["a$1\\b"]


def test_nfkc(spark):
    values = ["𝓕𝔯𝔞𝔫𝔠𝔢𝔰𝔠𝔞", "ﬁ ½ ＡＢ", "e\u0301", "é", "\u00a0", "ascii", None]
    want = [None if v is None else unicodedata.normalize("NFKC", v) for v in values]
    assert column(spark, values, text.nfkc) == want
    assert want[0] == "Francesca"


def test_settled_texts_are_left_alone(monkeypatch):
    """Normalised texts of the corpus languages reach no Python call of their own."""
    points = text.unsettled_points()
    settled = ["Привет, мир", "гьа кӀвал", "日本語の文", "한국어", "naïve café", "", None, "\U0001f600", "xy"]
    assert all(t is None or unicodedata.is_normalized("NFKC", t) for t in settled)
    calls = []
    monkeypatch.setattr(text, "normalize", lambda form, t: calls.append(t) or unicodedata.normalize(form, t))
    assert text.composed(pa.array(settled), points).to_pylist() == settled and not calls
    mixed = ["ﬁ", *settled, "e\u0301", "\u1100\u1161", "\uac00\u11a8", "ß"]
    want = [t and unicodedata.normalize("NFKC", t) for t in mixed]
    for start in range(3):
        part = pa.array(["ab", "é", *mixed]).slice(2 - start)
        assert text.composed(part, points).to_pylist()[start:] == want
    assert set(calls) == {"ﬁ", "e\u0301", "\u1100\u1161", "\uac00\u11a8"}


def test_unsettled_rows_over_many_portions(monkeypatch):
    monkeypatch.setattr(text, "CHECKED_TOGETHER", 40)
    draw = random.Random(1)
    letters = [*"abя日é\u0301\u1161ﬁ½\uac00\U0001d4d5", "x" * 50]
    texts = [None if draw.random() < 0.1 else "".join(draw.choice(letters) for _ in range(draw.randint(0, 9))) for _ in range(300)]
    want = [t and unicodedata.normalize("NFKC", t) for t in texts]
    assert text.composed(pa.array(texts), text.unsettled_points()).to_pylist() == want


def test_texts_without_unsettled_points_are_normalised():
    """Any pair of settled characters stays as it is: what joins the one before is in the table."""
    unsettled = set(text.unsettled_points().tolist())
    draw = random.Random(2)
    settled = [c for c in range(0x110000) if c not in unsettled and not 0xD800 <= c < 0xE000]
    for _ in range(300):
        t = "".join(chr(draw.choice(settled)) for _ in range(2000))
        assert unicodedata.is_normalized("NFKC", t)
    assert all(unicodedata.normalize("NFKC", chr(c)) == chr(c) for c in settled)
    pairs = [unicodedata.decomposition(chr(c)).split() for c in range(0x110000)]
    assert all(int(p[1], 16) in unsettled for p in pairs if len(p) == 2 and p[0][0] != "<")


def test_preprocess_keeps_null_and_is_idempotent_on_ascii(spark):
    assert column(spark, [None, "a\u00adb“"], text.preprocess) == [None, 'a b"']
    once = column(spark, ["Hello ( world ) , 5 % ''ok''  done ."], text.preprocess)
    assert column(spark, once, text.preprocess) == once


def test_preprocess_on_a_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("“a”",), ("b\tc",)], "t string").write.parquet(source)
    query = (
        spark.readStream.schema("t string")
        .parquet(source)
        .select(text.preprocess(F.col("t")).alias("t"))
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    assert sorted(r.t for r in spark.read.parquet(sink).collect()) == ['"a"', "b c"]


def test_other_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.createDataFrame([("é", "es")], "t string, lang string").write.parquet(path)
    clean = spark.read.parquet(path).withColumn("c", text.preprocess(F.col("t"))).where("lang = 'es'")
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,es)" in plan


def test_all_code_points(spark):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(pa.table({"c": pa.array(codes, pa.int32()), "t": pa.array([f"x{chr(c)}y" for c in codes])}))
    got = df.select("c", text.replace_nonprint(F.col("t")).alias("p"), text.nfkc(F.col("t")).alias("n")).toArrow()
    wrong = [
        c
        for c, p, n in zip(*(got.column(i).to_pylist() for i in range(3)))
        if p != ("x y" if unicodedata.category(chr(c))[0] == "C" else f"x{chr(c)}y")
        or n != unicodedata.normalize("NFKC", f"x{chr(c)}y")
    ]
    assert wrong == []


def test_chars_and_words(spark):
    assert column(spark, ["aӀ😀", "", None], text.chars) == [["a", "Ӏ", "😀"], [], None]
    assert column(spark, [" a\u2003b\n", "", "   "], text.words) == [["a", "b"], [], []]


def test_hash32_is_the_md5_prefix(spark):
    import hashlib

    got = spark.range(3).select(hash32(42, F.col("id"))).collect()
    want = [int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:8], 16) for i in range(3)]
    assert [r[0] for r in got] == want


def test_draws_reach_beyond_32_bits(spark):
    total = 1 << 34
    drawn = spark.range(200).select(F.pmod(hash60(1, F.col("id")), F.lit(total)).alias("p")).collect()
    assert sum(r.p >= 1 << 32 for r in drawn) > 100 and max(r.p for r in drawn) < total


def test_languages(spark):
    got = column(spark, ["Русский", "Лезги чlал", "rus_Cyrl", "x"], languages.resolve_lang)
    assert got == ["rus_Cyrl", "lez_Cyrl", "rus_Cyrl", "x"]
    assert languages.column_of("lez_Cyrl") == "lez"
    assert [x.column for x in languages.check_direction("lez_Cyrl", "rus_Cyrl")] == ["lez", "ru"]
    for bad in (("rus_Cyrl", "rus_Cyrl"), ("en", "lez_Cyrl")):
        with pytest.raises(ValueError):
            languages.check_direction(*bad)
    rows = spark.createDataFrame([("rus_Cyrl", "rus_Cyrl")], "a string, b string")
    with pytest.raises(Exception, match="not a supported direction"):
        rows.select(languages.assert_direction(F.col("a"), F.col("b"))).collect()
