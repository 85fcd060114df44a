"""B1 over lists that are not only texts, against the printed form of Python values."""
from qualm.functions.text import to_text

CASES = {
    None: "", "plain": "plain", "[broken": "[broken", "[not a list]": "[not a list]", "[]": "",
    '["true", "x"]': "true\nx", '[true, "x", null]': "True\nx", "['a', None]": "a", '["a", null, "b"]': "a\nb",
    '[["a", 1], {"k": false}]': "['a', 1]\n{'k': False}", "[1, 1.50, 1e3]": "1\n1.5\n1000.0", ' ["q\\n\\"w"] ': 'q\n"w',
}


def test_to_text_spells_items_as_python_does(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string")
    got = {r.i: r.out for r in to_text(df, "t", "out").collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())


def test_to_text_joins_arrays(spark):
    df = spark.createDataFrame([([True, None, False],), (None,)], "t array<boolean>")
    assert [r.t for r in to_text(df, "t").collect()] == ["True\nFalse", ""]
