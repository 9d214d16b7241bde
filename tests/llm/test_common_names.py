from clausewise.llm import name_variants as N


def linked(spark, names):
    d = spark.createDataFrame([("party", n) for n in names], "name_group string, name string")
    return {(r.name_a, r.name_b) for r in N.same_names(d).collect()}


def test_links_stay_when_a_block_grows(spark, monkeypatch):
    monkeypatch.setattr(N, "COMMON", 0)
    monkeypatch.setattr(N, "COMMON_REFINED", 1)
    names = ["William Gefarnu", "Bill Gefarnu", "Robert P. Thordarki", "Bob Thordraki", "Nimami Foods S.A.", "Niammi Foods S.A.", "Pilepar Min. Inc.", "Pilepar Minerals Inc.", "澹水市祥昌晖物流有限公司", "澹水昌祥晖物流有限公司", "澹水市诚岭炜物流有限公司", "诚岭炜物流有限公司"]
    pairs = {tuple(sorted(names[i : i + 2])) for i in range(0, len(names), 2)}
    assert linked(spark, names) == pairs


def test_more_names_than_a_block_holds(spark):
    others = [f"{a}{b}ia Gefarnu" for a in "bcdfghjklmnpqrst" for b in "aeou"]
    assert tuple(sorted(("William Gefarnu", "Bill Gefarnu"))) in linked(spark, [*others, "William Gefarnu", "Bill Gefarnu"])
