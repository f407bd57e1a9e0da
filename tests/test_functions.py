"""Identity, coercion, markup and JSON functions at their edges."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quaylight.functions import coerce as C
from quaylight.functions import identity as I
from quaylight.functions import jsontext as J
from quaylight.functions import markup as M
from quaylight.functions import vectors as V


def col(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://twitter.com/a/status/123?s=20", "x.com/status/123"), ("https://x.com/i/web/status/123/photo/1", "x.com/status/123"), ("https://mobile.twitter.com/i/status/123", "x.com/status/123"),
        ("http://fxtwitter.com/u/statuses/9", "x.com/status/9"), ("https://x.com/i/article/77", "x.com/i/article/77"), ("https://x.com/u/articles/77", "x.com/i/article/77"),
        ("https://www.bilibili.com/video/BV1ab411c7de?p=2", "bilibili.com/video/BV1ab411c7de"), ("https://WWW.Example.com:8080/a/b/?b=2&utm_source=x&a=1&share_id=3#frag", "https://example.com:8080/a/b?a=1&b=2"),
        ("https://example.com/?page=2&from=z", "https://example.com?page=2"), ("not a url", None), ("https://[bad", None), (None, None),
    ],
)
def test_canonical_link(url, want):
    assert I.canonical_link(url) == want


def test_links_of():
    assert I.links_of("[a](https://m.n/x) see https://e.org/wiki/Foo_(bar). 看https://e.org/z很好 (https://e.org/q)") == ["https://m.n/x", "https://e.org/wiki/Foo_(bar)", "https://e.org/z", "https://e.org/q"]
    assert I.links_of(None) == [] and I.links_of("https://") == []


def test_stored_link_keeps_the_host():
    assert I.stored_link("HTTPS://www.X.com/a/?utm_x=1&id=5") == "https://www.x.com/a?id=5" and I.stored_link("plain ") == "plain"


def test_fingerprints(spark):
    body = "ａｂｃ DEF 这是一段足够长的文字内容用来计算指纹值"
    same = "abc def，这是一段足够长的文字内容！用来计算指纹值 https://a.b/c"
    assert I.folded_fingerprint(body) == I.folded_fingerprint(same) is not None
    assert I.folded_fingerprint("short") is None and I.folded_fingerprint(None) is None
    got = col(spark, ["x" * 24, "x" * 23, "X" * 24 + "!", None], "string", I.text_fingerprint)
    assert got == [hashlib.sha1(b"x" * 24).hexdigest(), None, hashlib.sha1(b"x" * 24).hexdigest(), None]
    assert I.seen_keys("https://x.com/a/status/5") == ["url:" + hashlib.sha1(b"x.com/status/5").hexdigest()]
    assert I.index_keys("https://x.com/a/status/5 https://x.com/i/article/7") == ["a:7", "t:5"]


def test_bare_links(spark):
    assert col(spark, ["https://a.b/c 看看", "https://a.b/c 这是一句完整的编辑评论不是裸链", "no link", "", None], "string", I.is_bare_link) == [True, False, False, False, False]


def test_entry_and_topic_ids(spark):
    df = spark.createDataFrame([("A 活动!", None, "bug"), ("a活动", "", "BUG"), ("b", "https://e.org/x?utm_a=1", "bug"), ("c", "https://E.org/x/", "bug")], "t string, u string, c string")
    a, b, c, d = (r[0] for r in df.select(I.entry_fingerprint(F.col("t"), F.col("u"), F.col("c"))).collect())
    assert a == b != c == d
    assert col(spark, ["A 活动!", "a活动"], "string", I.topic_id)[0] == hashlib.sha256("a活动".encode()).hexdigest()[:12]


def test_coercion(spark):
    assert col(spark, ["5", " 7.0 ", "7.5", "x", None, "-3"], "string", C.whole_number) == [5, 7, None, None, None, -3]
    assert col(spark, ["5", "11", "-1", "nan", None], "string", C.score_to_ten) == [5.0, 0.0, 0.0, 0.0, 0.0]
    assert col(spark, ["0.5", "5", "50", "500", "x"], "string", C.score_to_one) == [0.5, 0.5, 0.5, 0.0, 0.0]
    assert col(spark, ["是", "No", "maybe", None], "string", C.flag) == [True, False, False, False]
    assert col(spark, ["PT1H2M3S", "P1DT1S", "P", "1:02"], "string", C.iso_duration_seconds) == [3723, 86401, None, None]
    assert col(spark, ["1h2m3s", "45s", "", "x"], "string", C.clock_duration_seconds) == [3723, 45, None, None]
    assert col(spark, [3723, 45, 120, 0, None], "long", C.duration_text) == ["1h2m3s", "45s", "2m0s", None, None]
    assert col(spark, [1.3, 1.0, 0.8, None], "double", C.trend_mark) == ["↑", "=", "↓", "–"]
    assert col(spark, ["1704067200", "1704067200000", "0"], "string", lambda x: C.epoch_seconds(x).cast("long")) == [1704067200, None, None]
    assert col(spark, ["a", "z", None], "string", lambda x: C.one_of(x, ["a"], "d")) == ["a", "d", "d"]
    assert col(spark, [0.0], "double", lambda x: C.device_time(x).cast("long")) == [978307200]


def test_markup(spark):
    assert col(spark, ["<b>a</b> &amp;lt; &gt;"], "string", M.visible_text) == ["a < >"]
    assert col(spark, ["a_b*[c]"], "string", M.escaped_markdown) == [r"a\_b\*\[c\]"]
    assert col(spark, ["[x](https://a.b)"], "string", M.links_as_html) == ['<a href="https://a.b">x</a>']
    assert col(spark, ['x [a & "b"](https://a.b?c=1&d) & [e](https://f) "', "none", None], "string", M.links_as_html) == ['x <a href="https://a.b?c=1&amp;d">a &amp; &quot;b&quot;</a> & <a href="https://f">e</a> "', "none", None]
    assert [tuple(x) for x in col(spark, ["<b>x</b>", "<b>" + "y" * 1030 + "</b>"], "string", M.caption)] == [("<b>x</b>", "HTML"), ("y" * 1024, None)]
    assert col(spark, ["a/b:c\\d"], "string", M.safe_file_name) == ["a_b_c_d"]
    assert col(spark, ["台湾护照和签证，猪肝护照"], "string", M.masked_phrases) == ["台湾" + M.MASK + "和" + M.MASK + "，猪肝" + M.MASK]
    assert col(spark, ["a\nPROMO x\n\n\n\nb"], "string", lambda x: M.without_lines(x, ["^PROMO"])) == ["a\n\nb"]
    assert col(spark, ["ok", "👍👍", "哈哈哈哈", "有内容的话", None, "中文字"], "string", M.is_low_content) == [True, True, False, False, True, False]
    assert col(spark, ["📢 频道 · 12:30\nx", "📢 @who hi", "👤 up · 3m", "x\n## 今日日报", "⚠ a", "MacRumors", None], "string", M.producer) == ["chatdaily_raw", "x_monitor", "bilibili", "daily_summary", "alert", "macrumors", "other"]
    md = "### 2025-01-01 10:00\n\n[系统] joined\n\n### 2025-01-01 10:01\n\n**a**: hi [捂脸] there\n\n### 2025-01-01 10:02\n\n**b**: [图片] local_id=5\n\n"
    got = col(spark, [md], "string", M.cleaned_export)[0]
    assert "系统" not in got and "捂脸" not in got and "**b**" not in got and "**a**: hi there" in got
    assert col(spark, ["a b\nc d", "xyz"], "string", lambda x: M.verbatim(x, F.lit("bcd"))) == ["b\nc d", None]


def cut_in_turn(text, limit):
    """Parts, one cut after the other."""
    out = []
    while len(text) > limit:
        ends = [i for i in range(limit // 2, limit) if text[i] == "\n"]
        at = ends[-1] if ends else limit
        out.append(text[:at].rstrip("\n"))
        text = text[at:].lstrip("\n")
    return out + [text] if text or not out else out


def test_message_parts(spark):
    rng = random.Random(4)
    texts = ["", "x" * 100, "x" * 101, "x" * 100 + "\n\n", "a" * 60 + "\n" + "b" * 60 + "\n\n" + "c" * 250, "\n" * 130 + "z", "😀" * 150 + "\n"]
    texts += ["".join(rng.choice("ab\n" if rng.random() < 0.3 else "abc") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    assert col(spark, texts, "string", lambda x: M.message_parts_col(x, 100)) == [cut_in_turn(t, 100) for t in texts]
    assert col(spark, [None], "string", M.message_parts_col) == [[""]]


def test_verbatim(spark):
    for text, quote, want in [("他说 (a+b)*c 。", "说(a+b)*c", "说 (a+b)*c"), ("x\u3000y z", "xyz", "x\u3000y z"), ("abc", "", None), ("abc", None, None), (None, "a", None), ("a.c", "abc", None), ("a\\b", "a\\b", "a\\b")]:
        df = spark.createDataFrame([(text, quote)], "t string, q string")
        assert df.select(M.verbatim(F.col("t"), F.col("q"))).collect()[0][0] == want


def test_card_body(spark):
    from quaylight.functions.text import card_body_col

    texts = ["📢 head\n👤 me\nsee [here](https://a.b/c) https://x.y at 12:30 ok  ", None, " \n ", "x" * 5000, "body\n  👤 up · 3m\nmore", "📢 only", "112:30 and 12:301 and 9:05", "👤 \nx", "a\u3000 b\u2028👤 q\u2028c"]
    assert col(spark, texts, "string", card_body_col) == ["see here at ok", "", "", "x" * 1500, "body more", "", "112:30 and 12:301 and", "👤 x", "a b c"]


def test_summary_parts():
    ok = "hi\n```markdown concise\nA\n```py\nx\n```\nB\n```\n```markdown detailed\nD\n```json opportunities\n{\"a\": [1,]}\n```\n```json\n{\"checked_claims\": 1"
    assert J.summary_parts(ok) == ("A\n```py\nx\n```\nB", "D", '{"a":[1]}', '{"checked_claims":1}', "")
    assert J.summary_parts("nothing") == (None, "", J.NO_OPPORTUNITIES, None, "concise,verification")
    assert J.summary_parts("```markdown concise\r\nx\r\n```\r\n```json opportunities\nnope\n```\n```json verification\n{}\n```") == ("x", "", J.NO_OPPORTUNITIES, "{}", "opportunities")
    assert J.summary_parts(None)[0] is None


def test_media_of_json(spark):
    raw = ['{"photo": {"path": "/a/b.JPG", "n": 1}, "x": ["~c.png", "d.png", "/e.txt"]}', "bad", None, '{"webpage": "u"}']
    assert col(spark, raw, "string", J.image_paths) == [["/a/b.JPG", "~c.png"], [], [], []]
    assert col(spark, raw, "string", J.has_media) == [True, False, False, True]
    assert col(spark, raw[:1] + raw[3:], "string", J.media_type) == ["图片", "链接卡片"]


def test_json(spark):
    texts = ['{"a": 1}', 'say ```json\n{"a": 2}\n``` ok', 'well {"a": 3} then', "none", "[1]", None]
    assert col(spark, texts, "string", lambda x: F.try_variant_get(J.rescued_json(x), "$.a", "int")) == [1, 2, 3, None, None, None]
    assert col(spark, ['{"a": [1, 2,], }', '{"a": "x', r'{"a": "\u12"}', "nope"], "string", J.tolerant_json)[:2] == ['{"a":[1,2]}', '{"a":"x"}']
    assert list(J.leaves('{"a": [1, {"b": "x"}], "c": null}')) == [("$.a[0]", "1"), ("$.a[1].b", "x"), ("$.c", None)] and list(J.leaves("bad")) == []
    assert list(J.fences("x\n```markdown concise\nhi\n```json\n{}\n```\nmore\n```\n```json\n1\n```")) == [("markdown", "concise", "hi\n```json\n{}\n```\nmore", 0), ("json", "", "1", 1)]
    J.register_json_functions(spark)
    assert spark.sql("""select path, value from json_leaves('{"k": 1}')""").collect()[0] == ("$.k", "1")


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_cards(spark):
    from quaylight.functions import cards as K

    assert col(spark, ["微信/群 / 子", "Telegram / x", "QQ / x", " a ", "微信", None], "string", K.source_label) == ["群 / 子", "x", "QQ / x", "a", "微信", None]
    assert col(spark, ["# rubric v12 x\nv3", "x\nv3", "", None, "av1 v2"], "string", K.rubric_version) == ["v12", "v0", "v0", "v0", "v2"]
    assert col(spark, [10.5, 9.6, 12.0, 7.5, None], "double", lambda x: K.signed_delta(x, F.lit(10.0), "次")) == ["0次", "0次", "+2次", "-2次", "—"]
    assert col(spark, [7.5, 0.0, 1.999, None], "double", K.hours_text) == ["7小时30分", "0小时00分", "2小时00分", "—"]
    assert col(spark, ["**a<b** and **c", "x"], "string", K.rendered_point) == ["<b>a&lt;b</b> and c", "x"]
    md = 'a ![x](tg://photo?id=ab "t") b ![y](tg://video?id=abc) c'
    assert col(spark, [md], "string", lambda x: K.without_media(x, F.lit("ab"))) == ["a  b ![y](tg://video?id=abc) c"]
    rows = [("meme", 0.7, ["f"], ""), ("meme", 0.8, ["f"], ""), ("chart", 0.5, [], ""), ("chart", 0.5, ["f"], None), ("chart", 0.9, ["f"], "一张表情包"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "kind string, worth double, facts array<string>, said string")
    assert [r[0] for r in df.select(K.is_empty_image(F.col("kind"), F.col("worth"), F.col("facts"), F.col("said"))).collect()] == [True, False, True, False, True, False]
