import numpy as np
import pytest

from clausewise.llm import name_variants as N
from clausewise.llm import personal as P
from clausewise.llm import scan_repair as R

FIRMS = ["澹水市澄珂凯律师事务所", "澄珂凯（澹水）律师事务所", "澹水澄珂凯律师事物所", "澄珂凯律所", "律师事务所：澹水澄珂凯", "溯阳市淳柏清律师事务所"]
PARTIES = [
    "澜州市南慧绣能源股份有限公司", "南慧绣（澜州）能源股份有限公司", "澜州南慧绣源能股份有限公司", "澜州 南慧绣 能源股份有限公司", "南慧绣能源公司", "澜州市南慧绣船舶集团有限公司", "澜州南慧绣船舶集团有限公司（盖章）",
    "桐泊市诚岭炜物流有限公司", "澹水市祥昌晖物流有限公司", "澹水昌祥晖物流有限公司", "祝泽琛", "祝 泽琛", "祝泽琛先生", "俞诚祥",
    "Nimami Foods S.A.", "Niammi Foods S.A.", "Foods Nimami S.A.", "NIMAMI FOODS S.A.", "Nimami Energy S.A.", "Pilepar Min. Inc.", "Pilepar Minerals Inc.",
    "Elizabeth P. Gefarnu", "Liz Gefarnu", "Gefarnu, Elizabeth", "E. Gefarnu", "Leonard Gegapar", "Leonard Thordarki",
]


def linked(spark, names):
    d = spark.createDataFrame(names, "name_group string, name string").selectExpr("*", "'x' as core", "1 as node")
    return {(r.name_group, r.name_a, r.name_b) for r in N.same_names(d).collect()}


def test_names(spark):
    got = linked(spark, [("law_firm", n) for n in FIRMS] + [("party", n) for n in PARTIES] + [("party", None), ("party", ""), ("party", " "), ("party", PARTIES[0])])
    groups = [FIRMS[:5], PARTIES[:5], PARTIES[5:7], PARTIES[8:10], PARTIES[10:13], PARTIES[14:18], PARTIES[19:21], PARTIES[21:25]]
    wanted = {("law_firm" if g is groups[0] else "party", *sorted((a, b))) for g in groups for i, a in enumerate(g) for b in g[i + 1 :]}
    assert got == wanted
    assert linked(spark, [("party", "祝泽琛")]) == set()
    assert N.same_names(spark.createDataFrame([], "name_group string, name string")).count() == 0


def test_very_long_names(spark):
    long = "甲乙丙" * 20_000
    assert linked(spark, [("party", long), ("party", long[:-1]), ("party", long + "（盖章）"), ("party", "x" * 50_000), ("party", "x y " * 5_000)]) == {("party", long, long + "（盖章）")}


def test_typed_characters_are_learned(spark):
    cores = [f"{s}{a}{b}" for s in "祝俞卢" for a in "泽诚盛恒" for b in "琛祥桐林"]
    wrong = ["祝择琛", "俞择祥", "卢择林"]
    d = spark.createDataFrame([("han", c) for c in cores + wrong], "kind string, core string")
    assert {tuple(r) for r in N.misspelled_characters(d).collect()} == {("择", c) for c in "泽"} | {("择", c) for c in "诚盛恒"}


@pytest.mark.parametrize("a,b,same", [("bokotha", "bkootha", True), ("textiles", "textilles", True), ("thordarki", "thormargi", False), ("ab", "ba", False)])
def test_slip(a, b, same):
    assert N.slip(a, b) is same


TEXT = """民事起诉状
原告：蒯腾顺，男，证件号码 992027650605678，地址 峤南市东栈区砚池西路125弄4号141室，Tel:197-2680-3690
法定代表人阙桐锦，总经理
被告：远本清（竺陵）服饰有限公司，统一社会信用代码91998295MA29655054
被告：Shipuben Foods Co., Ltd.
担保人胥宏璟，身份证９９１２１５１９６１０５１２２２１９，护照E12345678，订单流水482673181184448640。
2025年1月6日，郝煜泽在101 Old Kiln Street, Suite 16, Orvelle签收催告函。对账单发往邮箱parze-sha [at] litigroup [dot] test，抄送财务。
另可拨打0967-7791382 ext. 849或致信Vardo＠farden.example与Theodore Lusazu联系。其电话已作隐去处理（138****6895），以[姓名]代称。
致：Elizabeth P. Gefarnu
子公司法定代表人采用电子签名的应当限期整改，担保人提供连带责任保证。收款账号6200 3533 7936 4307。邮政信箱684号"""
FOUND = {
    ("person_name", "蒯腾顺"), ("id_number", "992027650605678"), ("address", "峤南市东栈区砚池西路125弄4号141室"), ("phone", "197-2680-3690"), ("person_name", "阙桐锦"),
    ("person_name", "胥宏璟"), ("id_number", "９９１２１５１９６１０５１２２２１９"), ("id_number", "E12345678"), ("person_name", "郝煜泽"), ("address", "101 Old Kiln Street, Suite 16, Orvelle"),
    ("email", "parze-sha [at] litigroup [dot] test"), ("phone", "0967-7791382 ext. 849"), ("email", "Vardo＠farden.example"), ("person_name", "Theodore Lusazu"), ("person_name", "Elizabeth P. Gefarnu"),
}


def test_personal_data():
    assert {(k, TEXT[a:b]) for a, b, k in P.find(TEXT)} == FOUND


@pytest.mark.parametrize("text,kind,value", [("电话一三八〇〇一二三四五六。", "phone", "一三八〇〇一二三四五六"), ("手机(+86)19996311064", "phone", "(+86)19996311064"), ("户籍地：砚东省簌川市澄湾县柏台路404号，", "address", "砚东省簌川市澄湾县柏台路404号"), ("屠昌益收 a.b(at)c.test", "email", "a.b(at)c.test"), ("mаil＠shаre.test", "email", "mаil＠shаre.test")])
def test_disguises(text, kind, value):
    assert (kind, value) in {(k, text[a:b]) for a, b, k in P.find(text)}


def test_redaction_keeps_the_rest(spark):
    out = P.redact(TEXT)
    assert "138****6895" in out and "6200 3533 7936 4307" in out and "[NAME]，男，证件号码 [ID]，地址 [ADDRESS]，Tel:[PHONE]" in out
    assert P.find(out) == [] or all(k == "person_name" for *_, k in P.find(out)) is False
    d = spark.createDataFrame([("f", 1, TEXT), ("f", 2, None), ("f", 3, ""), ("f", 4, "x" * 200_000), ("f", 1, TEXT)], "field string, id bigint, text string").selectExpr("*", "1 as kind")
    assert {(r.kind, r.value) for r in P.personal_data(d).collect()} == FOUND
    assert {r.id: r.text for r in P.redacted(d.where("id in (2, 3)")).collect()} == {2: None, 3: ""}


@pytest.mark.parametrize("line", ["25", "第五页", "Page 2 of 71", "〔3〕", "- 16 -", "— 17 —", "第 16 页 共 48 页", "P.17", "第5页/共76页", "6/12", "·2·"])
def test_page_numbers(line):
    assert R.PAGE_NUMBER.match(line)


@pytest.mark.parametrize("line", ["第五条", "2018-02-28.", "五", "第3期", "保存不少于5年。", "Page"])
def test_no_page_numbers(line):
    assert not R.PAGE_NUMBER.match(line)


def test_running_lines():
    text = "砚山印章管理办法\n正文第一行，\n砚山印章管理办法（2016版）  | 2\n第二行。\n- 3 -"
    assert R.cleaned(text, "砚山印章管理办法", False)[1:] == (["砚山印章管理办法", "砚山印章管理办法（2016版）  | 2"], ["- 3 -"])
    assert R.cleaned("砚山印章管理办法\n干净的正文。\n第二段。", "砚山印章管理办法", True)[1] == []
    assert R.cleaned("404 Not Found\n砚山印章管理办法", "砚山印章管理办法", True)[1] == []


def test_broken_words():
    text = "The cou-\n nsel should recon­\r\ncile the export-\ncontrol and cust-\nod-\nian."
    assert R.mend_words(text)[1] == [("counsel", "cou-nsel"), ("reconcile", "recon-cile"), ("exportcontrol", "export-control"), ("custodian", "cust-od-ian")]


def test_confusion_cost():
    assert R.confusion_cost("procurernent", "procurement") < 0.5 and R.confusion_cost("tbe", "the") < 0.5 and R.confusion_cost("house", "mouse") >= 0.6


def test_scan_noise(spark):
    clean = "项目负责人应当限期整改，编号CG-2020-12345，共15个工作日。The contract owner shall reconcile the export-control classification."
    noisy = "页眉测试管理办法\n顶目负责人应当恨期整改，编号CG-2O20-12345，\n共l5个工作日。The contract owner shall recon-\ncile tbe export-\ncontrol\n- 3 -\nclassification."
    rows = [("kb_chunk.content", i, clean, None, False) for i in range(60)] + [("kb_chunk.content", 100, noisy, "页眉测试管理办法", False), ("kb_chunk.content", 101, "", None, False)]
    d = spark.createDataFrame(rows, "field string, id bigint, text string, title string, whole boolean")
    got = {tuple(r) for r in R.scan_noise(d).select("id", "kind", "value").collect()}
    assert got == {(100, "running_header", "页眉测试管理办法"), (100, "page_number", "- 3 -"), (100, "broken_word", "reconcile"), (100, "broken_word", "export-control"), (100, "misread", "")}
    assert R.scan_noise(d.limit(0)).count() == 0


def test_scan_noise_behind_a_sieve_that_lets_all_pass(spark, monkeypatch):
    clean = "项目负责人应当限期整改。"
    d = spark.createDataFrame([("f", i, clean, None, False) for i in range(40)] + [("f", 99, "顶目负责人应当限期整改。", None, False)], "field string, id bigint, text string, title string, whole boolean")
    monkeypatch.setattr(R, "sieve", lambda units: np.full(1 << (R.SIEVE - 6), (1 << 64) - 1, dtype=np.uint64))
    assert [tuple(r) for r in R.scan_noise(d).collect()] == [("f", 99, "misread", "")]


def test_very_long_texts():
    for text in ["x" * 200_000 + " a@b.test", " " * 200_000 + "(at) a", "电话 " + "1" * 200_000, "路" * 200_000 + "1", "（" * 100_000]:
        assert len(P.redact(text)) > 0
    for text in ["a" * 200_000 + "-\n" + "b" * 100_000, " " * 200_000 + "\n" + "9" * 100_000, "第" * 100_000 + "\n5"]:
        body, *_ = R.cleaned(text, "标题标题", False)
        R.tokens(R.join_lines(R.flowing(R.mend_words(body)[0])))
