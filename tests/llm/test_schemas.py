"""Schema trees and canonical numbers of tool calls."""

import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from hondana.llm.op2_tools import Array, Enum, Number, Object, canonical, errors_of

TREE = {
    "f": {
        "n": ("number", False), "i": ("integer", False), "s": ("string", False), "b": ("boolean", False), "z": ("null", False), "x": ("any", False),
        "e": (Enum(("a", 1, None, [1, 2], 2.50)), False), "r": (Number(0, 10), False), "w": (Number(1, 3, integer=True), False),
        "o": (Object({"p": ("string", True), "q": (Array("integer"), False), "deep": (Object({"k": ("boolean", True)}, closed=False), False)}), False),
        "l": (Array(Object({"t": ("string", True)})), False),
    },
    "open": Object({"a": ("string", True)}, closed=False), "none": Object({}),
}


def errors(spark, cases):
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(cases)], "k int, name string, arguments string")
    return [r.e for r in rows.withColumn("e", errors_of(TREE)).orderBy("k").collect()]


def test_schema_trees(spark):
    cases = [
        ('{"n":0.5}', []), ('{"n":2}', []), ('{"n":1e300}', []), ('{"n":"2"}', ["type of n"]), ('{"n":null}', ["type of n"]), ('{"i":3.0}', []), ('{"i":1e2}', []), ('{"i":3.5}', ["type of i"]),
        ('{"i":12345678901234567890123456789012345678901}', []), ('{"s":"\\u0001#5"}', []), ('{"s":"\\u00015"}', []), ('{"i":"\\u00015"}', ["type of i"]), ('{"s":5}', ["type of s"]), ('{"b":true}', []), ('{"b":0}', ["type of b"]),
        ('{"z":null}', []), ('{"z":0}', ["type of z"]), ('{"x":null}', []), ('{"x":[{}]}', []), ('{"e":"a"}', []), ('{"e":1.0}', []), ('{"e":null}', []), ('{"e":[1, 2]}', []), ('{"e":25e-1}', []), ('{"e":"b"}', ["value of e"]), ('{"e":true}', ["value of e"]),
        ('{"r":10}', []), ('{"r":10.01}', ["range of r"]), ('{"r":"1"}', ["type of r"]), ('{"w":2}', []), ('{"w":2.5}', ["type of w"]), ('{"w":4}', ["range of w"]),
        ('{"o":{"p":"x"}}', []), ('{"o":{}}', ["missing o.p"]), ('{"o":{"p":1,"u":1}}', ["type of o.p", "unknown o.u"]), ('{"o":{"p":"x","q":[1,"2",2.5,3]}}', ["type of o.q[]"]), ('{"o":[]}', ["type of o"]),
        ('{"o":{"p":"x","deep":{"k":1,"any":2}}}', ["type of o.deep.k"]), ('{"l":[]}', []), ('{"l":[{"t":"x"},{"t":null},{},{"v":1}]}', ["type of l[].t", "missing l[].t", "unknown l[].v"]), ('{"l":{}}', ["type of l"]),
        ('{"y":1,"a b":2}', ["unknown a b", "unknown y"]), ("{}", []), ("[]", ["malformed arguments"]), ("{", ["malformed arguments"]), (None, ["malformed arguments"]), ('{"n":01}', ["malformed arguments"]), ('{"n":1.}', ["malformed arguments"]),
    ]
    assert errors(spark, [("f", t) for t, _ in cases]) == [e for _, e in cases]
    assert errors(spark, [("open", '{"a":"x","b":1}'), ("open", "{}"), ("none", "{}"), ("none", '{"a":1}'), (None, "{}"), ("g", "{}")]) == [[], ["missing a"], [], ["unknown a"], ["unknown tool"], ["unknown tool"]]


def forms(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.c for r in rows.withColumn("c", canonical(F.col("t"))).orderBy("k").collect()]


def test_one_form_for_every_number(spark):
    same = [["100", "1e2", "100.0", "1.0E+2", "0.1e3"], ["0", "-0", "0.000", "0e9"], ["-0.5", "-5e-1", "-0.50"], ["1E300", "1e300", "10e299"], ["0.00012", "1.2e-4"], ["1E-40", "1e-40", "0.1e-39"]]
    for group in same:
        assert forms(spark, group) == [group[0]] * len(group)
    digits = "12345678901234567890123456789012345678901"
    assert forms(spark, [digits, f"0.{digits}", f'{{"b": {digits}, "a": [1.50 , "1.50"]}}', "1e9999999999999999999999"]) == [digits, f"0.{digits}", f'{{"a":[1.5,"1.50"],"b":{digits}}}', "1e9999999999999999999999"]
    assert forms(spark, ['"\\u00015"', '["\\u0001\\u00017"]', '{"\\u00011":1}']) == ['"\\u00015"', '["\\u0001\\u00017"]', '{"\\u00011":1}']
    assert forms(spark, ["--1", "[1,]", "", None, '"a', "01"]) == [None] * 6
    assert len(forms(spark, ['{"a":"' + "x\\n" * 200_000 + '","b":' + "[1.0," * 400 + "1" + "]" * 400 + "}"])[0]) > 600_000


def test_numbers_keep_their_values(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(400):
        whole = rng.choice(["0", str(rng.randrange(1, 10 ** rng.randrange(1, 30)))])
        texts.append(rng.choice(["", "-"]) + whole + rng.choice(["", f".{rng.randrange(10**6):06d}", ".0"]) + rng.choice(["", f"e{rng.randrange(-40, 40)}", f"E+{rng.randrange(9)}"]))
    got = forms(spark, texts)
    assert [Decimal(a) for a in got] == [Decimal(b) for b in texts]
    again = forms(spark, got)
    assert again == got and all(json.loads(x) == json.loads(x) for x in got)
