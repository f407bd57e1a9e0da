"""Decisions and assembly over records."""

from pyspark.sql import functions as F

from quaylight.functions import identity
from quaylight.operators import records as R


def test_gates(spark):
    long = "这是一段足够长的文字内容用来计算指纹值再多一些字"
    seen = spark.createDataFrame([(k, o, o) for t, o in ((long, 1), ("https://a.b/c", 2)) for k in identity.seen_keys(t)] + [(identity.seen_keys("https://a.b/c")[0], 9, 9)], "key string, owner long, order long")
    new = spark.createDataFrame([(10, long + "！"), (11, "看 https://a.b/c"), (12, "一段完整的评论当然总是要送达的 https://a.b/c"), (13, "new"), (14, None)], "id long, text string")
    got = {r.id: (r.skip, r.reason, r.owner) for r in R.gate_decisions(new, seen, "id", "text").collect()}
    assert got == {10: (True, "text", 1), 11: (True, "url", 2), 12: (False, "", None), 13: (False, "", None), 14: (False, "", None)}


def test_gate_judges_every_document(spark, tmp_path):
    from datetime import datetime

    from quaylight.plans import core_queries

    word = lambda c: f"这是一段足够长的文字内容用来计算指纹值再多一些字{c}"
    texts = {1: word("甲"), 2: "new", 3: word("甲") + "！", 4: None, 5: "https://a.b/c", 6: word("乙"), 7: word("乙"), 8: "看 https://a.b/c", 9: "一段完整的评论当然总是要送达的 https://a.b/c", 10: word("乙")}
    day = {i: datetime(2024, 1, i) for i in texts} | {6: datetime(2024, 1, 20)}  # comes last
    spark.createDataFrame([(i, t, day[i]) for i, t in texts.items()], "doc_id long, text string, published_at timestamp").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.skip, r.reason, r.owner) for r in core_queries()["gate_decisions"](spark, str(tmp_path)).collect()}
    held = {3: (True, "text", 1), 8: (True, "url", 5), 6: (True, "text", 7), 10: (True, "text", 7)}
    assert got == {i: held.get(i, (False, "", None)) for i in texts}


def test_gate_equals_one_post_after_another(spark):
    import random

    rng = random.Random(5)
    texts = [" ".join(["这是一段足够长的文字内容用来计算指纹值再多一些字" + rng.choice("甲乙丙丁戊")] * rng.randint(0, 1) + [f"https://a.b/{rng.randint(0, 12)}" for _ in range(rng.randint(0, 3))]) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    bare = {r.id: r.b for r in df.select("id", identity.is_bare_link(F.col("text")).alias("b")).collect()}
    owner, want = {}, {}
    for i, t in enumerate(texts):
        keys = identity.seen_keys(t)
        hits = [("text" if k.startswith("text:") else "url", owner[k]) for k in keys if k in owner and (k.startswith("text:") or bare[i])]
        want[i] = (True, *min(hits)) if hits else (False, "", None)
        if not hits:
            for k in keys:
                owner.setdefault(k, i)
    assert {r.id: (r.skip, r.reason, r.owner) for r in R.gate_decisions_in_order(df, "id", "text", ["id"]).collect()} == want
    assert any(w[0] for w in want.values())


def test_targets(spark):
    a = spark.createDataFrame([("a1", "T"), ("a2", "T"), ("a3", "U")], "id string, title string")
    b = spark.createDataFrame([("b1", "T"), ("a1", "x"), ("b2", "U")], "id string, title string")
    s = spark.createDataFrame([("a1",), (" U ",), ("T",), ("?",), (None,)], "target string")
    assert [(r.table_no, r.id) for r in R.resolved_targets(s, "target", a, b).orderBy(F.monotonically_increasing_id()).collect()].count((None, None)) == 2
    got = {r.target: (r.table_no, r.id) for r in R.resolved_targets(s, "target", a, b).collect()}
    assert got["a1"] == (0, "a1") and got[" U "] == (0, "a3") and got["T"] == (1, "b1")


def test_quotes_are_relocated(spark):
    m = spark.createDataFrame([("s", 1, "x", "hello  there friend"), ("s", 2, None, "other long content")], "span string, msg_id long, sender string, content string")
    q = spark.createDataFrame([("s", 0, 2, "hello there"), ("s", 1, 2, "long content"), ("s", 2, 1, "absent words"), ("s", 3, 1, "hi"), ("s", 4, None, "friend"), ("s", 5, 2, "content")], "span string, pos int, msg_id long, text string")
    got = [tuple(r) for r in R.valid_quotes(q, m).orderBy("pos").collect()]
    assert got == [("s", 0, 1, "x", "hello  there"), ("s", 1, 2, "", "long content"), ("s", 4, 1, "x", "friend")]


def test_posts(spark):
    rows = [(1, 11, None, "a", [("p", "photo")]), (2, 12, 5, " ", [("q", "photo")]), (3, 13, 5, "cap", None), (4, 14, 5, "later", [("r", "video")]), (5, 15, None, None, None)]
    df = spark.createDataFrame(rows, "seq long, msg_id long, grouped_id long, text string, media array<struct<path:string,kind:string>>")
    got = [(r.text, r.msg_ids, [x.path for x in r.media]) for r in R.grouped_posts(df).orderBy("seq").collect()]
    assert got == [("a", [11], ["p"]), ("cap", [12, 13, 14], ["q", "r"]), ("", [15], [])]


def test_sections_citations_claims(spark):
    text = "# t\n## 总览\n- a [IMG1] b\n## AI\n- **T**：版本 1.2 [IMG1] [IMG2]\n- [x](https://e.f) [IMG3]\n## 其他\n- z [IMG4][IMG9]\n- 发布 y（群 / 10:00）"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    s = {r.section: r["items"] for r in R.sections(df, "id", "text", {"总览": "o", "AI": "ai"}).collect()}
    assert s == {"o": ["a b"], "ai": ["T：版本 1.2", "x"]}
    known = spark.createDataFrame([(1, i) for i in (1, 2, 3, 4)], "id int, image_id long")
    c = {(r.image_id, r.at) for r in R.kept_citations(df, "id", "text", known, "AI", "总览").collect()}
    assert c == {(1, 4), (2, 4), (3, 5)}
    assert [r.claim for r in R.claims(df, "id", "text").orderBy("pos").collect()] == ["T 版本 1.2 [IMG1] [IMG2]", "发布 y"]


def test_texts(spark):
    df = spark.createDataFrame([("（长名群；长名 / a）长名", "他说「真 话」和「假话」", ["真话"], "## H & **b**\n- x <y>\n\nz", [" **p** ", "", None, "q" * 90])], "a string, i string, q array<string>, m string, p array<string>")
    r = df.select(R.abbreviated(F.col("a"), {"长名": "短", "长名群": "群"}), R.without_false_quotes(F.col("i"), F.col("q")), R.message_html(F.col("m")), R.clean_points(F.col("p"))).first()
    assert tuple(r) == ("（群；短 / a）长名", "他说「真 话」和假话", "<b>H &amp; <b>b</b></b>\n• x &lt;y&gt;\n\nz", ["**p**", "q" * 80])


def test_models_fail_open(spark):
    def model(texts):
        if "boom" in texts:
            raise ValueError
        return [len(t) for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "boom", "ccc", None])], "id int, t string").coalesce(1)
    got = [r.n for r in R.with_model(df, "t", model, "n", "long", batch=2).orderBy("id").collect()]
    assert got == [1, 2, None, None, 0]


def test_thresholds_and_titles(spark):
    df = spark.createDataFrame([(0, 0.7, False), (1, 0.8, True), (1, 0.8, False), (2, 0.9, True)], "band int, low double, same boolean")
    assert tuple(R.suggested_thresholds(df, "band", "low", F.col("same")).first()) == (0.8, 0.9)
    t = spark.createDataFrame([("c", 1, "great offer today"), ("c", 2, "great offer todax"), ("c", 3, "else"), ("d", 4, "great offer today"), ("c", 5, None)], "cat string, n long, title string")
    assert {r.n: r["head"] for r in R.merged_by_title(t, "cat", "n", "title").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_first_heads_equal_full_comparison():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(6)
    titles = ["".join(rng.choice("abcdefg汉字") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    heads, want = [], []
    for i, t in enumerate(titles):
        j = next((h for h, u in heads if SequenceMatcher(None, u, t).ratio() >= 0.65), i)
        heads += [(i, t)] if j == i else []
        want.append(j)
    assert R.first_heads(list(range(200)), titles, 0.65) == want
