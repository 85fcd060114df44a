"""Stems of words whose stem the published description gives, and the stemmed score."""
import pytest

from qualm.functions.rouge import rouge_l
from qualm.functions.stem import stem

PUBLISHED = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "differentli": "differ",
    "vileli": "vile", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun",
    "activate": "activ", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
    # extensions
    "dies": "die", "died": "die", "flies": "fli", "spied": "spi", "skies": "sky", "dying": "die", "enjoy": "enjoy", "geology": "geolog",
}


@pytest.mark.parametrize("word", PUBLISHED)
def test_published_stems(word):
    assert stem(word) == PUBLISHED[word]


def test_stemmed_score(spark):
    df = spark.createDataFrame([(1, "The cats were running", "a cat is run"), (2, "is was", "is wa"), (3, None, "x"), (4, "", "")],
                               "id int, p string, r string")
    got = {r.id: r.rougeL for r in rouge_l(df, "p", "r", use_stemmer=True).collect()}
    assert got[1] == pytest.approx(0.5)
    assert got[2] == pytest.approx(0.5) and got[3] == got[4] == 0.0
