import random

from pyspark.sql import functions as F

from pagestrata.functions import bidi

HE, AR = "שלום", "سلام"


def test_reordering_of_plain_lines():
    assert bidi.reorder("abc " + HE) == "abc " + HE[::-1]
    assert bidi.reorder(HE + " abc 12") == "abc 12 " + HE[::-1]
    assert bidi.reorder(HE + " 1,234.5 " + HE) == HE[::-1] + " 1,234.5 " + HE[::-1]
    assert bidi.reorder("plain (text), 12%") == "plain (text), 12%"
    assert bidi.reorder(AR + "\n" + "abc") == AR[::-1] + "\nabc"


def test_visual_lines_come_back():
    """What is set from right to left by the algorithm is read back in order, for lines of words and numbers."""
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice([HE, AR, "דבר", "12", "2024"]) for _ in range(rng.randint(1, 7))]
        words[0] = HE
        logical = " ".join(words)
        classes = [bidi.unicodedata.bidirectional(c) for c in logical]
        visual = "".join(logical[i] for i in bidi.visual_order(bidi.levels(["R" if c == "AL" else c for c in classes], 1)))
        assert bidi.logical_line(visual, bidi.RTL) == logical, (logical, visual)


def test_protected_words():
    assert bidi.reconstruct("user@example.com " + HE[::-1] + " " + HE[::-1]) == HE + " " + HE + " user@example.com"
    assert bidi.reconstruct("no right-to-left text: 12") == "no right-to-left text: 12"
    assert bidi.has_compact_mixed("A4" + HE) and not bidi.has_compact_mixed("A4 " + HE) and bidi.is_ltr_prefixed_mixed("A4" + HE) and not bidi.is_ltr_prefixed_mixed(HE + "A4")
    assert bidi.base_direction("abc " + HE) == (bidi.LTR, "ambiguous") and bidi.base_direction(HE + " x " + HE) == (bidi.RTL, "inferred") and bidi.base_direction("abc")[1] == "exact"


def test_presentation_forms_and_words():
    assert bidi.normalize_forms("\ufefb\ufb01") == "\u0644\u0627\ufb01" and bidi.normalize_whole("\ufefb\ufb01") == "\u0644\u0627fi"
    assert bidi.reorder_words(["a", HE, AR, "b", "12"]) == [4, 3, 2, 1, 0] and bidi.reorder_words(["a", "b"]) == [0, 1]
    assert bidi.reorder_words([HE, AR, "x", "y", HE]) == [4, 2, 3, 1, 0]
    assert [bidi.word_class(w) for w in (HE, "x1", "12")] == ["rtl", "ltr", "neutral"]
    assert "".join(t for _, t in bidi.reconstruct_elements([HE[::-1], " ", "12"])) == "12 " + HE or bidi.reconstruct_elements(["a"]) == [(0, "a")]


def test_columns(spark):
    df = spark.createDataFrame([(1, HE[::-1] + " " + HE[::-1], ["a", HE]), (2, "plain", ["a", "b"]), (3, None, None)], "id int, t string, w array<string>")
    got = {r["id"]: r for r in df.select("id", bidi.reconstructed(F.col("t")).alias("r"), bidi.contains_rtl(F.col("t")).alias("c"), bidi.word_order(F.col("w")).alias("o"), bidi.reordered(F.col("t")).alias("v")).collect()}
    assert (got[1]["r"], got[1]["c"], got[1]["o"]) == (HE + " " + HE, True, [1, 0])
    assert (got[2]["r"], got[2]["c"], got[2]["o"], got[2]["v"]) == ("plain", False, [0, 1], "plain") and got[3]["r"] is None
