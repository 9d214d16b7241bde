import numpy as np
import pytest

from clausewise.llm import scan_repair as R

TEXT = "field string, id bigint, text string, title string, whole boolean"
CLEAN = "项目负责人应当限期整改，编号CG-2020-12345，共15个工作日。The contract owner shall reconcile the procurement classification under export-control."
NOISY = "页眉测试管理办法\n顶目负责人应当恨期\n整改，编号CG-2O20-12345，\n共1S个工作日。\n- 3 -\nTbe contract owner shall recon-\ncile the procure-\nrnent classification under export-\ncontrol."
CUT_ONLY = "The contract owner shall reconcile the procure-\nrnent classification under export-control."


def rows(spark):
    return spark.createDataFrame([("f", i, CLEAN, None, False) for i in range(60)] + [("f", 100, NOISY, "页眉测试管理办法", False), ("f", 101, CUT_ONLY, None, False)], TEXT)


@pytest.mark.parametrize("worth", [None, True])
def test_texts_come_out_repaired(spark, monkeypatch, worth):
    if worth:
        # a sieve that lets everything pass gives the same
        monkeypatch.setattr(R, "sieve", lambda units: np.full(1 << (R.SIEVE - 6), (1 << 64) - 1, dtype=np.uint64))
    got = {r.id: r.text for r in R.scan_repaired(rows(spark)).collect()}
    assert got[100] == CLEAN.replace("。The", "。\nThe") and got[101] == CLEAN.split("。")[1] and {got[i] for i in range(60)} == {CLEAN}
    assert R.scan_repaired(rows(spark).limit(0)).count() == 0


def test_a_misread_cut_word_is_found_and_put_right(spark):
    got = {tuple(r) for r in R.scan_noise(rows(spark)).where("id = 101").select("kind", "value").collect()}
    assert got == {("broken_word", "procurement"), ("misread", "")}


def test_paragraphs_keep_genuine_breaks():
    text = "砚山印章管理办法\n第一章 总则\n第一条 印章由专人\n保管。\n（一）公章；\n（二）合同章。\n附件7：清单\n\nThe owner\nshall act."
    assert R.paragraphs(text, "砚山印章管理办法") == text.replace("专人\n", "专人").replace("owner\n", "owner ")
    assert R.put_right("甲，\r\n乙", {}, {}, R.Repairs([]).middles) == "甲，\r\n乙"


@pytest.mark.parametrize("seen,meant", [("视定", "规定"), ("没立", "设立"), ("负贵", "负责"), ("员貂", "员工")])
def test_misread_ideographs_outside_a_short_list(spark, seen, meant):
    clean = "按规定设立机构并由专人负责通知员工办理。"
    rows = [("f", i, clean, None, False) for i in range(60)] + [("f", 99, clean.replace(meant, seen), None, False), ("f", 98, clean.replace("专人", "两名专人"), None, False)]
    d = spark.createDataFrame(rows, TEXT)
    assert [tuple(r) for r in R.scan_noise(d).select("id", "kind").collect()] == [(99, "misread")]
    assert {r.text for r in R.scan_repaired(d).where("id = 99").collect()} == {clean}


@pytest.mark.parametrize("seen", ["5oO3.ZO9S", "SO03.ZO9S", "50O3.2095"])
def test_any_number_of_letters_read_for_digits(spark, seen):
    rows = [("f", i, f"合计金额为{5000 + i}.{2000 + i}元整。", None, False) for i in range(60)] + [("f", 99, f"合计金额为{seen}元整。", None, False), ("f", 98, "合计金额为XKWT.VKRT元整。", None, False)]
    d = spark.createDataFrame(rows, TEXT)
    assert [tuple(r) for r in R.scan_noise(d).select("id", "kind").collect()] == [(99, "misread")]
    assert {r.text for r in R.scan_repaired(d).where("id = 99").collect()} == {"合计金额为5003.2095元整。"}


def test_long_tokens_and_days_with_letters(spark):
    clean = "编号" + "1234567890" * 7 + "，共15个工作日。"
    rows = [("f", i, clean, None, False) for i in range(60)] + [("f", 98, clean.replace("15", "l5"), None, False), ("f", 99, clean.replace("90123", "9O123"), None, False)]
    d = spark.createDataFrame(rows, TEXT)
    assert {r.id for r in R.scan_noise(d).collect()} == {98, 99}


def test_long_words_and_lines_have_no_limit(spark):
    long = "procurement" * 60
    rows = [("f", i, f"The {long} clause applies.", None, False) for i in range(60)] + [("f", 99, f"The {long[:300]}-\n{long[300:]} clause applies.", None, False), ("f", 98, f"The {long[:-4]}rnent clause applies.", None, False)]
    d = spark.createDataFrame(rows, TEXT)
    assert {(r.id, r.kind, r.value) for r in R.scan_noise(d).collect()} == {(99, "broken_word", long), (98, "misread", "")}
    assert {r.text for r in R.scan_repaired(d).collect()} == {f"The {long} clause applies."}
    title = "采购与供应商管理办法" * 15
    assert R.cleaned(f"甲\n{title}\n乙。", title, False) == ("甲\n乙。", [title], [])
    assert R.header_base("办法 | 12") == "办法" and R.header_base("办法  12") == "办法" and R.header_base("办法 12") == "办法 12"


def test_banded_cost_equals_the_full_one():
    def full(seen, meant):
        cost = {}
        for i in range(len(seen) + 1):
            for j in range(len(meant) + 1):
                best = 0.0 if not i and not j else 9e9
                if i:
                    best = min(best, cost[i - 1, j] + 1)
                if j:
                    best = min(best, cost[i, j - 1] + 1)
                if i and j:
                    best = min(best, cost[i - 1, j - 1] + (seen[i - 1] != meant[j - 1]))
                    best = min([best] + [cost[i - len(x), j - len(y)] + 0.3 for x, y in R.LETTER_PAIRS if seen.endswith(x, 0, i) and meant.endswith(y, 0, j)])
                cost[i, j] = best
        return min(1.0, cost[len(seen), len(meant)])

    rng = np.random.default_rng(2)
    for _ in range(1500):
        a = "".join(rng.choice(list("rnmclidhvwu"), size=rng.integers(1, 9)))
        b = a
        for _ in range(rng.integers(0, 4)):
            x, y = R.LETTER_PAIRS[rng.integers(len(R.LETTER_PAIRS))]
            b = b.replace(x, y, 1)
        assert abs(R.confusion_cost(a, b) - full(a, b)) < 1e-9


def test_words_at_the_end_of_a_paragraph_are_put_right(spark):
    rows = [("f", i, "The owner should periodically act on 2017-09-26 here.", None, False) for i in range(60)] + [("f", 99, "The owner sbould\n\nperiodically act on 20I7-09-26\n\nhere.", None, False)]
    d = spark.createDataFrame(rows, TEXT)
    assert {r.text for r in R.scan_repaired(d).where("id = 99").collect()} == {"The owner should\n\nperiodically act on 2017-09-26\n\nhere."}
