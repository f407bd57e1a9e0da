"""Cut texts: the reading of ends, the two kinds of evidence, and planted cuts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.llm import minhash as M
from quaylight.llm import truncation as C

WHOLE = [
    "It was merged.", "好的。", "他说“好。”", "see https://a.example/x/123456", "done.\n\n#tag #other", "done.\n\n-- some.one", "ok.\n```\nrun --it\n```", "好。👍",
    "完。\n\n（完）", "fine. [end]", "a title that ends well...", "“quoted.”\r\n", "done.&nbsp;", "done.</p>", None, "", "  \n",
]
CUTS = ["It was mer", "the first one,", "它们的差别主", "他们准备�", "It was merged after lunch without touching the mod...", "see the [source](https", "（长尾跑", "run\n```\nrun --li", "value is 42,3", "- **Bold", "the result is…"]


OPEN = ("word", "number", "other", "open", "lone")


@pytest.mark.parametrize("text", [t for t in WHOLE if t and t.strip()])
def test_closings_of_whole_texts(text):
    if text == "a title that ends well...":  # whole as a remark of its own
        assert C.closing(text)[0] == "word in a short line"
    else:
        assert not C.closing("This is a longer text. " * 4 + text)[0].startswith(OPEN)


@pytest.mark.parametrize("text", CUTS)
def test_closings_of_cut_texts(text):
    assert C.closing("This is a longer text. " * 4 + text)[0].startswith((*OPEN, "link"))


def test_short_lines_are_told_apart():
    assert C.closing("已更新")[0] == "word in a short line" and C.closing("monitor digest replaced……")[::2] == ("word in a short line", "long ellipsis")
    assert C.closing("It is so. monitor digest")[0] == "word after a sentence" and C.closing("word " * 20)[0] == "word in a long line"
    assert C.closing("\u200b \n")[0] == "blank" and C.closing("...")[0] == "stop"


def test_the_end_is_found_behind_any_length_of_tail():
    assert C.closing("Done and dus" + "\u200b " * 5000)[0] == "word in a short line"
    assert C.closing("Done. And dus" + "." * 9000)[::2] == ("word after a sentence", "dots")


def test_terminality_is_learned_from_counts():
    """Brackets that stand at ends far more often than inside are whole, words are cut; with other counts it is the other way round."""
    ends = {("stop", ""): 900, ("bracket", ""): 300, ("word after a sentence", ""): 100, ("word after a sentence", "dots"): 8, ("word in a short line", ""): 90}
    inside = {"stop": 60, "bracket": 20, "word after a sentence": 2000, "word in a short line": 60}
    share = C.fit_terminality(ends, inside)
    assert share["word after a sentence", ""] > 0.9 and share["word after a sentence", "dots"] > 0.9
    assert max(share["stop", ""], share["bracket", ""], share["word in a short line", ""]) < 0.1
    # texts that close with words by habit: what stands inside is brackets, and ends in brackets are the cut ones
    share = C.fit_terminality({("word after a sentence", ""): 9000, ("bracket", ""): 2000}, {"bracket": 5000, "word after a sentence": 50})
    assert share["word after a sentence", ""] < 0.1 and share["bracket", ""] > 0.5
    assert C.fit_terminality({}, {}) == {}


def test_link_shape():
    assert C.link_shape("https://a.b/foo/123?x=1") == "h2/a/9"
    assert C.link_shape("https://a") == "h1" and C.link_shape("https:") == "h0"


def test_word_shingles():
    h, b = C.word_shingles(["one two three four five six", "", "ONE,two three-four five", "甲乙丙丁戊己", "a b"])
    assert b.tolist() == [0, 2, 2, 3, 5, 6] and h[0] == h[2]
    assert len(set(h.tolist())) == 5
    long, lb = C.word_shingles(["x y z w v " * 3000])
    assert lb.tolist() == [0, 14996] and len(set(long.tolist())) == 5


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    rows = []
    for i in range(300):
        body = " ".join(word() for _ in range(60)) + "."
        tail = rng.choice(["", "\n\n#alpha #beta", "\n\n#beta #alpha", f"\nhttps://s{i}.example/{word()}/{rng.randint(10**5, 10**6)}", "\n\n-- alice", ""])
        rows.append((i, body + f" see https://t.example/{word()}/12345 now\n**alice**: hi there.\n#alpha #beta ok." + tail, "post"))
    return rows


def found(spark, rows):
    return {r.doc_id for r in C.find_cut(spark.createDataFrame(rows, "doc_id long, text string, kind string").withColumn("id", F.lit(1)).withColumn("item", F.lit("")), "doc_id", "text").collect()}


def test_evidence(spark):
    rows = corpus()
    assert found(spark, rows) == set()
    full = rows[0][1].split("\n\n")[0] + "\nhttps://q.example/kappa/778899"
    cut = [
        (1001, rows[1][1].split("\n\n")[0] + "\n\n#alpha #be", "post"),  # the beginning of a tag that stands complete elsewhere
        (1002, rows[2][1].split("\n\n")[0] + "\n\n-- ali", "post"),
        (1003, rows[3][1].split("\n\n")[0] + "\nhttps://t.exam", "post"),
        (1004, full[:-3], "post"),  # only its copy shows that the number goes on
        (1005, full[:-3], "post"),
        (1006, "It began well. The sentence stops in the mid", "post"),
    ]
    assert found(spark, rows + cut + [(1100, full, "post"), (1101, None, "post"), (1006, cut[-1][1], "post")]) == {1001, 1002, 1003, 1004, 1005, 1006}


def test_every_copy_of_a_bucket_is_met(spark):
    """In every bucket the source of a cut copy is neither the longest text nor the next longer one."""
    body = corpus()[0][1].split("\n\n")[0]
    link = "\nhttps://q.example/kappa/778899"
    longer = [(2100 + i, f"{body}\nhttps://q.example/kappa/{5500112233 + i}", "post") for i in range(12)]
    between = [(2200 + i, f"{body}\nhttps://q.example/kappa/{12340 + i}", "post") for i in range(12)]
    assert found(spark, [*corpus(), *longer, *between, (2001, body + link, "post"), (2002, body + link[:-3], "post")]) == {2002}


def test_a_stop_within_a_number_or_host_is_no_end(spark):
    body = corpus()[0][1].split("\n\n")[0]
    rows = corpus()
    for i, (head, rest) in enumerate([("It rose to 3.", "5 million."), ("It needs v2.", "1 at least."), ("Ask at example.", "org today."), ("That is all.", " And more of it."), ("That is all.", "Next one."), ("这就完成了.", "下一步。")]):
        own = " ".join(f"{w}{i}" for w in body.split())
        rows += [(3000 + i, f"{own} {head}{rest}", "post"), (4000 + i, f"{own} {head}", "post")]
    assert found(spark, rows) == {4000, 4001, 4002}


def test_the_whole_copy_is_searched():
    t = "The quick brown fox jumps over the lazy dog and then it leaves for good and ever."
    assert C.ends_early(t[:50] if t[50].isalnum() and t[49].isalnum() else t[:49], "An opening that the other lacks. " * 20 + t)
    # the same tail again: at the very end, and far before
    link = "see https://q.example/kappa/7788"
    assert C.ends_early("One line. " + link, "One line. " + link + "99 now. Another line. " + link)
    assert not C.ends_early("One line. " + link + "99 now. Another line. " + link, "One line. " + link + "99 now. Another line. " + link + " it is.")
    assert C.ends_early("a" * 5000 + "b" * 5000, "a" * 5000 + "b" * 9000) and not C.ends_early("b" * 50000, "b" * 50000)


def test_pairs_from_open_rows(spark):
    rng = random.Random(3)
    rows = list({(rng.randint(0, 5), i % 60, i % 3 == 0) for i in range(180)})
    want = {(a, b) for k, a, o in rows for m, b, _ in rows if o and k == m and a != b}
    df = spark.createDataFrame(rows, "key long, id long, open boolean")
    assert sorted(tuple(r) for r in M.bucket_pairs_from(df, 4).collect()) == sorted(want)


def test_empty(spark):
    assert found(spark, []) == set()


def test_shares(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, None)], "doc_id long, source string")
    cut = spark.createDataFrame([(2, "word")], "doc_id long, reason string")
    got = {r.source: (r.records, r.cut, r.share) for r in C.share_by_source(df, cut, "doc_id", "source").collect()}
    assert got == {"a": (2, 1, 0.5), None: (1, 0, 0.0)}


def test_ends_early():
    t = "The quick brown fox jumps over the lazy dog and then it leaves for good."
    assert C.ends_early(t[:50], t) == (t[49].isalnum() and t[50].isalnum())
    assert not C.ends_early(t, t) and not C.ends_early("something else entirely different", t)
    assert np.all([not C.ends_early(t[:k], t) for k in range(len(t)) if t[k : k + 1] in (" ", ".")])
