import time

import pytest

from clausewise.llm import personal as P

NAMES = P.Names(frozenset("张祝"), frozenset("三泽琛伟"), frozenset({"Rebecca"}))


@pytest.mark.parametrize(
    "text,out",
    [
        ("电话138\u200b1234\u200b5678，", "电话[PHONE]，"),
        ("a\u200bbc@exam\u200bple.com 抄送", "[EMAIL] 抄送"),
        ("身份证9917071975\ufeff10030491。", "身份证[ID]。"),
        ("见ﬁona@litigroup.test", "见[EMAIL]"),
        ("call one three eight 1234 5678 now", "call [PHONE] now"),
        ("call one-three-eight one two three four five six seven eight", "call [PHONE]"),
        ("电话一三八12345六七八", "电话[PHONE]"),
        ("地址：石坞区槐荫大街27号院3号楼", "地址：[ADDRESS]"),
        ("地址：石坞区槐荫大街27号院3号楼1415，", "地址：[ADDRESS]，"),
        ("地址：石坞区槐荫大街27号院，", "地址：[ADDRESS]，"),
        ("张三住在石坞区。", "[NAME]住在石坞区。"),
        ("由祝泽琛签收", "由[NAME]签收"),
        ("he met Rebecca Sortardo there", "he met [NAME] there"),
        ("Rebecca Foods Co., Ltd. paid", "Rebecca Foods Co., Ltd. paid"),
        ("法院住在", "法院住在"),
        ("原告：祝泽琛，男\n后祝泽琛搬走，祝泽琛贸易有限公司未付款", "原告：[NAME]，男\n后[NAME]搬走，祝泽琛贸易有限公司未付款"),
    ],
)
def test_disguises(text, out):
    assert P.redact(text, NAMES) == out


def test_values_are_verbatim():
    text = "甲ﬁ＠ 138\u200b12345678 [at] x"
    assert [text[a:b] for a, b, _ in P.find(text)] == ["138\u200b12345678"]


def test_names_are_learned_from_labels(spark):
    rows = [("f", i, f"原告：张{c}伟，男") for i, c in enumerate("三伟三")] + [("f", 9, "后张三住在石坞区"), ("f", 10, None), ("f", 11, "")]
    d = spark.createDataFrame(rows, "field string, id bigint, text string")
    assert P.learned_names(d).first == {"张"}
    assert {r.value for r in P.personal_data(d).where("id = 9").collect()} == {"张三"}
    assert {r.id: r.text for r in P.redacted(d).where("id > 8").collect()} == {9: "后[NAME]住在石坞区", 10: None, 11: ""}
    assert P.learned_names(d.limit(0)) == P.Names()


@pytest.mark.parametrize("text", ["a" * 300_000, "\n" * 300_000, "1 2 3 " * 60_000, "路1" * 60_000, "one " * 60_000, "x@" * 100_000, "a." * 100_000 + "@", "（" * 200_000, "张三" * 60_000])
def test_long_texts_take_time_in_proportion(text):
    began = time.time()
    P.find(text, NAMES)
    assert time.time() - began < 20
