import random
import unicodedata

from clausewise.llm import canonical as C


def forms(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string").selectExpr("*", "'x' as pos", "'y' as ch")
    got = {r.key: r.form for r in C.canonical_forms(d).collect()}
    assert len(got) == len(texts)
    return [got[i] for i in range(len(texts))]


def test_same_reading_has_one_form(spark):
    pairs = [
        ("Ｎｏｔｉｃｅ，第１条", "Notice,第1条"),
        ("Chapter 8 N‎otifi­cation", "Chapter 8 Notification"),
        ("Notiﬁcation", "Notification"),
        ("Сhарtеr", "Chapter"),
        ("Sénor", "Sénor"),
        ("⼈⼤不", "人大不"),
        ("non‑stop—go", "non-stop-go"),
        ("a　b c", "a b c"),
    ]
    got = forms(spark, [x for p in pairs for x in p])
    for i, (a, b) in enumerate(pairs):
        assert got[2 * i] == got[2 * i + 1], (a, b)


def test_really_different_stays_different(spark):
    pairs = [("第1条", "第l条"), ("应当", "应 当"), ("A", "a"), ("①", "1"), ("x²", "x2"), ("甲\n乙", "甲乙"), ("é", "e"), ("入", "人"), ("0", "O")]
    got = forms(spark, [x for p in pairs for x in p])
    assert all(got[2 * i] != got[2 * i + 1] for i in range(len(pairs)))


def test_edges(spark):
    assert forms(spark, [None, "", "​", "平文", "ẹ́", "ẹ́"])[:4] == [None, "", "", "平文"]
    a, b = forms(spark, ["ẹ́x", "ẹ́x"])
    assert a == b == unicodedata.normalize("NFC", "ẹ́x")
    d = spark.createDataFrame([], "key bigint, text string")
    assert C.canonical_forms(d).count() == 0


def test_marks_are_ordered_and_composed_as_the_standard_has_it(spark):
    rng = random.Random(4)
    letters = ["a", "e", "o", "x", "ế", "Å", "中", "\u0301", "\u0302", "\u0323", "\u0327", "\u0308", "\u0338"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(400)]
    assert forms(spark, texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_many_rows_of_one_form(spark, monkeypatch):
    rows = [(i, None, "第１条" if i % 2 else "第1条", None) for i in range(30)]
    d = spark.createDataFrame(rows, "id bigint, document_id bigint, content string, section_title string")
    whole = {tuple(r) for r in C.equal_clauses(d).collect()}
    assert whole == {("kb_chunk.content", i, j) for i in range(30) for j in range(i + 1, 30) if (i - j) % 2}
    monkeypatch.setattr(C, "FORM_PART", 4)
    assert {tuple(r) for r in C.equal_clauses(d).collect()} == whole
    assert [tuple(r) for r in C.clause_classes(d).collect()] == [("kb_chunk.content", None, 0, 2, 30)]
    assert {r.form for r in C.clause_forms(d).where("field = 'kb_chunk.content'").collect()} == {"第1条"}


def test_long_texts(spark, monkeypatch):
    monkeypatch.setattr(C, "PORTION", 5)
    texts = ["Ａ" * 12, "e\u0301" * 9, "", "甲" * 5, "\u200b" * 7, "\u0301x"]
    assert forms(spark, texts) == ["A" * 12, "é" * 9, "", "甲" * 5, "", "\u0301x"]


def test_equal_clauses(spark):
    rows = [(1, 1, "第１条", "题一"), (2, 1, "第1条", "题 一"), (3, 2, "第1条", "题 一"), (4, 2, ".", None), (5, 2, "．", "题 一"), (6, None, None, "x"), (7, 1, "第1条", "题 一")]
    d = spark.createDataFrame(rows, "id bigint, document_id bigint, content string, section_title string")
    got = {tuple(r) for r in C.equal_clauses(d).collect()}
    assert got == {("kb_chunk.content", 1, 2), ("kb_chunk.content", 1, 3), ("kb_chunk.content", 1, 7), ("kb_chunk.section_title", 2, 7), ("kb_chunk.section_title", 3, 5)}
    assert C.equal_clauses(d.limit(0)).count() == 0
