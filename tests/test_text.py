import random

import regex

from quarry import config
from quarry.functions import text as T

FIXTURE = "翻牌前3BET底池賠率怎麼算？對手加注者 Événement a_k_q_j_10"
EXPECTED = ["翻牌前", "3bet", "底池賠率", "怎", "麼", "算", "對手", "加注者", "événement", "a_k_q_j_10"]


def test_segment_fixture_spark(spark):
    row = spark.createDataFrame([(FIXTURE,)], "text string").select(T.tokens("text").alias("t")).collect()[0]
    assert row["t"] == EXPECTED


def test_trie_pattern_equals_longest_first_alternation():
    trie, flat = T.segment_pattern(dialect="re2"), T.flat_segment_pattern(dialect="re2")
    chars = list(set("".join(config.custom_words()))) + list("ab _19x")
    rnd = random.Random(7)
    for _ in range(2000):
        s = "".join(rnd.choice(chars) for _ in range(rnd.randint(0, 25)))
        assert regex.findall(trie, s) == regex.findall(flat, s)


def test_dictionary_words_stay_whole(spark):
    words = [w for w in config.custom_words()]
    df = spark.createDataFrame([(w,) for w in words], "text string")
    got = [r["t"] for r in df.select(T.tokens("text").alias("t")).collect()]
    assert got == [[w.lower()] for w in words]


def test_stopwords_keep_order_and_repeats(spark):
    df = spark.createDataFrame([("對手 的 對手 下注 了 下注",)], "text string")
    row = df.select(T.clean_tokens("text").alias("t"), T.clean_text("text").alias("c")).collect()[0]
    assert row["t"] == ["對手", "對手", "下注", "下注"]
    assert row["c"] == "對手 對手 下注 下注"


def test_missing_text_is_empty_not_nan(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(T.clean_text("text").alias("c")).collect()[0]["c"] == ""


def test_unicode_strip_and_blank(spark):
    df = spark.createDataFrame([("　 abc 　",), ("　\t",), (None,)], "text string")
    rows = df.select(T.strip("text").alias("s"), T.rstrip("text").alias("r"), T.is_blank("text").alias("b")).collect()
    assert rows[0]["s"] == "abc" and rows[0]["r"] == "　 abc"
    assert [r["b"] for r in rows] == [False, True, True]


def test_snippet(spark):
    df = spark.createDataFrame([("x" * 80,), ("y" * 81,), (None,)], "text string")
    got = [r["s"] for r in df.select(T.snippet("text").alias("s")).collect()]
    assert got == ["x" * 80, "y" * 80 + "...", ""]
