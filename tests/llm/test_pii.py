"""Personal data: held-out sentences, exact boundaries, the programme against brute force."""

import random
from itertools import combinations
from math import exp

import pytest
from pyspark.sql import functions as F

from quaylight.llm import pii as P
from quaylight.llm.pii_samples import NAMES, labelled

MODEL = P.trained()


def found(text):
    return [(s.kind, text[s.start : s.end]) for s in P.find(text, NAMES, MODEL)]


def test_held_out_sentences():
    hit = want = got = 0
    for text, gold in labelled(400, 77):
        f = {(s.start, s.end, s.kind) for s in P.find(text, NAMES, MODEL)}
        hit, want, got = hit + len(f & gold), want + len(gold), got + len(f)
    assert hit / want > 0.98 and hit / got > 0.98


#: Sentences that share no wording with those the model is fitted on.
HELD_OUT = (
    {
        "EMAIL": ["投稿邮箱为{}，截稿周五。", "可写邮件至{}询价。"], "PHONE": ["前台座机{}转分机。", "跟我通话请用{}，晚上也行。", "师傅的手机 {} 打不通。"], "ID_NUMBER": ["办理时出示的证件是{}，复印件也行。", "系统里录着{}这个号。"],
        "ADDRESS": ["租的房子就在{}，离地铁近。", "展厅开在{}。", "包裹写{}即可。"], "NAME": ["主编{}改过一遍。", "同事{}下周结婚。", "合影里左边是{}，", "收信人：{}"],
    },
    {
        "EMAIL": ["Forward everything to {} by Monday.", "My inbox is {}."], "PHONE": ["The hotline {} is open all night.", "Office line: {}."], "ID_NUMBER": ["The clerk typed {} twice."],
        "ADDRESS": ["The parcel went to {} instead.", "Rooms for rent, {}, no pets."], "NAME": ["The letter came from {} in May.", "We elected {} as chair.", "Minutes taken by {}"],
    },
)


def test_held_out_wording():
    hit = want = got = 0
    for text, gold in labelled(600, 11, HELD_OUT):
        f = {(s.start, s.end, s.kind) for s in P.find(text, NAMES, MODEL)}
        hit, want, got = hit + len(f & gold), want + len(gold), got + len(f)
    assert hit / want > 0.97 and hit / got > 0.97


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("邮箱：a.b+c＠site.org，备注", [("EMAIL", "a.b+c＠site.org")]),
        ("to x_y [at] site [dot] org twice", [("EMAIL", "x_y [at] site [dot] org")]),
        ("Send to ab @ site . org. Contact us", [("EMAIL", "ab @ site . org")]),
        ("see @handle for more. Order 8812345678", []),
        ("tel:(+86)13812345678打 +44 (0)7700 900123 找", [("PHONE", "(+86)13812345678"), ("PHONE", "+44 (0)7700 900123")]),
        ("电话１３８１２３４５６７８，", [("PHONE", "１３８１２３４５６７８")]),
        ("(568) 555-0155 or 1-647-555-0162.", [("PHONE", "(568) 555-0155"), ("PHONE", "1-647-555-0162")]),
        ("慢唱片99 13812345678", [("PHONE", "13812345678")]),
        ("版本 10.21.46，ip 10.88.40.56，会议号 4741-3121，2025-01-11", []),
        ("SSN on file: 938-39-7582.", [("ID_NUMBER", "938-39-7582")]),
        ("Address: 501B Old Mill Close, Apt 34B, Fernley 69023, ring twice", [("ADDRESS", "501B Old Mill Close, Apt 34B, Fernley 69023")]),
        ("寄到云川省平海市槐花街474号7单元2374室。在槐花街附近", [("ADDRESS", "云川省平海市槐花街474号7单元2374室")]),
        ("欧阳格的攻略，欧阳青梧先生说", [("NAME", "欧阳青梧")]),
        ("Ask N. Linfield, or Dr. Linfield, Mirela", [("NAME", "N. Linfield"), ("NAME", "Linfield, Mirela")]),
        ("mirela.linfield@site.org", [("EMAIL", "mirela.linfield@site.org")]),
        ("写到 kim@corp.exampleThenWe left", [("EMAIL", "kim@corp.example")]),
        ("寄到云川省平海市槐花街474号" + "7单元" * 60 + "2374室。", [("ADDRESS", "云川省平海市槐花街474号" + "7单元" * 60 + "2374室")]),
        ("a" * 60 + "@" + ".".join(["b" * 60] * 3) + ".org", [("EMAIL", "a" * 60 + "@" + ".".join(["b" * 60] * 3) + ".org")]),
        ("Unlisted T. Harborwick", [("NAME", "Unlisted T. Harborwick")]),
        ("", []),
        (None, []),
    ],
)
def test_boundaries(text, want):
    assert found(text or "") == want


def test_check_digit():
    assert P.check_digit_ok("11010519491231002X") and not P.check_digit_ok("110105194912310021") and not P.check_digit_ok("123")


def test_programme_equals_brute_force():
    r = random.Random(1)
    for _ in range(60):
        spans = sorted((P.Span(a, a + r.randint(1, 6), "NAME", (f"f{i}",)) for i in range(7) for a in [r.randint(0, 12)]), key=lambda s: (s.end, s.start))
        m = P.SemiCRF({f"f{i}": r.uniform(-1, 2) for i in range(7)})
        sets = [c for n in range(8) for c in combinations(spans, n) if all(x.end <= y.start or y.end <= x.start for x, y in combinations(c, 2))]
        total = sum(exp(sum(map(m.score, c))) for c in sets)
        assert abs(sum(map(m.score, m.best(spans))) - max(sum(map(m.score, c)) for c in sets)) < 1e-9
        for s, p in zip(spans, m.marginals(spans)):
            assert abs(p - sum(exp(sum(map(m.score, c))) for c in sets if s in c) / total) < 1e-9


def test_operators(spark):
    rows = [("a", "k1", "text", "打 13812345678 找"), ("a", "k1", "text", "打 13812345678 找"), ("a", None, "text", None), ("a", "k2", "text", ""), ("a", "k3", "text", "x" * 50000 + " 13812345678")]
    df = spark.createDataFrame(rows, "tbl string, row_key string, place string, text string").withColumn("kind", F.lit(1))
    got = sorted((r.row_key, r.kind, r.found_text) for r in P.findings(df, NAMES).collect())
    assert got == [("k1", "PHONE", "13812345678"), ("k3", "PHONE", "13812345678")]
    assert P.findings(df.where("false"), NAMES).count() == 0
    red = [r[0] for r in df.select(P.redact(F.col("text"), NAMES)).collect()]
    assert red[:4] == ["打 [PHONE] 找", "打 [PHONE] 找", None, ""] and red[4].endswith("x [PHONE]")
    parts = spark.createDataFrame([("欧阳", "family"), (None, "given"), ("Alden", "given")], "name_part string, kind string")
    assert P.names_of(parts).family == {"欧阳"}
