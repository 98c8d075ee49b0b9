from pyspark.sql import functions as F

from conceptweave.functions.text import clean_line, sentences, tokens
from conceptweave.functions.vectors import l2_distance
from conceptweave.operators import stats


def one(spark, text, f, **options):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"), **options).alias("x")).first()[0]


def test_sentences_keep_abbreviations_dates_and_numbers(spark):
    assert one(spark, "Det koster ca. 5 kr. pr. dag. Den 3. maj bl.a. her!! Slut", sentences) == ["Det koster ca. 5 kr. pr. dag.", " Den 3. maj bl.a. her.", " Slut"]
    assert one(spark, "Se § 3, 1. pkt. og 2., 3. pkt. Jf. her.", sentences) == ["Se § 3, 1. pkt. og 2., 3. pkt.", " Jf. her."]
    assert one(spark, ".a. b", sentences) == [".", "a.", " b"]  # a leading dot drops nothing


def test_sentences_of_nothing(spark):
    assert one(spark, None, sentences) is None
    assert one(spark, "", sentences) == []


def test_law_dialects(spark):
    assert one(spark, "Se nr. 2.\nGælder. § 3", sentences, dialect="lov") == ["Se nr. 2.", "Gælder.", " § 3"]
    assert one(spark, "se stk. 2.og 3.", sentences, dialect="lbk") == ["se stk. 2.og 3."]


def test_tokens(spark):
    assert one(spark, "Den ca. 5 Æbler og THE pære\nx", tokens) == ["den", "æbler", "pærex"]
    assert one(spark, "pære\nx", tokens, newline_to_space=True) == ["pære", "x"]
    assert one(spark, "Den 3. maj 2020 kl. 5", clean_line) == "den maj"


def test_document_frequency_of_the_toy_example(spark):
    bow = spark.createDataFrame([(1, "hallo"), (1, "du"), (2, "du"), (2, "der"), (3, "du"), (3, "der"), (3, "jeg")], "id long, word string")
    assert dict(stats.document_frequency(bow).collect()) == {"du": 3, "der": 2, "hallo": 1, "jeg": 1}


def test_upsert_lets_the_last_write_win(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, stats.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_upsert_of_keys_that_repeat_or_are_null(spark):
    cols = "id long, v string, at int"
    old = spark.createDataFrame([(1, "a", 0), (None, "n", 0), (9, "old", 0)], cols)
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "x", 1), (2, "x", 1), (2, "y", 1), (None, "m", 1)], cols)
    assert sorted((str(r.id), r.v) for r in stats.upsert(old, new, ["id"], ["at"]).collect()) == [("1", "b"), ("2", "y"), ("9", "old"), ("None", "m")]
    assert stats.upsert(old, new.filter("false"), ["id"]).count() == 3


def test_idf_in_one_pass(spark):
    import math

    rows = spark.createDataFrame([(1, "hund kat hund"), (2, "kat"), (3, None), (4, "")], "id long, text string")
    found = {r.word: (r.df, round(r.idf, 9)) for r in stats.idf_of(rows, "id").collect()}
    assert found == {"hund": (1, round(math.log(4 / 2), 9)), "kat": (2, round(math.log(4 / 3), 9))}
    _, idf = stats.add_documents(rows, spark.createDataFrame([(2, "hund"), (5, "fugl")], "id long, text string"))
    assert {r.word: r.df for r in idf.collect()} == {"hund": 2, "kat": 1, "fugl": 1}


def test_l2(spark):
    assert spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<float>, b array<float>").select(l2_distance(F.col("a"), F.col("b"))).first()[0] == 5.0


def test_double_percent_signs_stay(spark):
    from conceptweave.functions.text import sentences

    df = spark.createDataFrame([("50%% i dag. Ca. 3%% mere.",)], "text string")
    assert df.select(sentences(F.col("text")).alias("s")).first().s == ["50%% i dag.", " Ca. 3%% mere."]
