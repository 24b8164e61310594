"""List texts against Python's own reading of them."""

import ast
import random
import warnings

from pyspark.sql import functions as F

from marquee.functions import read_records

TEXTS = [
    "[{'id': 1, 'name': u'A'}]",
    "[{'id': 1, 'name': '''A'''}]",
    '[{"id": 1, "name": """A "q" \'x\'\nline"""}]',
    "[{'id': 1, 'name': 'A' 'B'}]",
    "[{'id': 1, 'name': 'A'}, (1, 2)]",
    "[{'id': 1, 'name': 'A'}, (1,), ((2)), ()]",
    "[{'id': 1, 'name': 'A'}, None]",
    "[{'id': 1,'name': 'A',}, ]",
    r"[{'id': 1, 'name': 'A\U0001F600B é\xe9\101\0'}]",
    r"[{'id': 1, 'name': '\N{LATIN SMALL LETTER E WITH ACUTE}t\N{GREEK SMALL LETTER ALPHA}'}]",
    r"[{'id': 1, 'name': r'A\n' R'\\'}]",
    "[]",
    "[{'id': 1_000, 'name': 'x'  \"y\"  u'z'}, {'id': +5, 'name': '('}, {'id': -5, 'name': '),'}]",
    r"[{'id': 1, 'name': '\N{NO SUCH THING}'}]",
    r"[{'id': 1, 'name': '\U00110000'}]",
    "[{'id': 1, 'name': 'A'}",
    "[{'id': 1, 'name': A}]",
    "({'id': 1, 'name': 'A'},)",
    "[{'name': 'O\\'R', 'id': None}]",
    "[{'id': (1), 'name': ('a\\qb')}]",
    "[{'id': 1, 'name': 'A'}] x",
    "[{'id': 1, 'name': 'A\\\nB'}]",
    "[{'id': 1, 'name': '\\a\\v\\\\'}, {'id': 2, 'name': '\\\\N{x}'}]",
    "[{'id': '1' , 'name': ''}, 'text', 5, [1], {'id': 2, 'name': \"it's\"}]",
    "[{'id': 1, 'name': 'A\nB'}]",
    "[{'id': 1, 'name': 'A}]",
    "",
    "None",
]


def expected(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            value = ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return None
    if not isinstance(value, list):
        return None
    rows = [(d.get("id"), d.get("name")) for d in value if isinstance(d, dict)]
    return [(None if i is None else str(i), name) for i, name in rows]


def found(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = frame.select("i", read_records(F.col("t")).alias("r")).orderBy("i").collect()
    return [None if row.r is None else [(x.id, x.name) for x in row.r if x is not None] for row in rows]


def test_every_form(spark):
    # A line end within one pair of quotes is no literal, but JSON texts with one are read.
    assert found(spark, TEXTS[:24]) == [expected(text) for text in TEXTS[:24]]
    assert found(spark, TEXTS[25:]) == [None] * 3


def test_bytes_are_no_names(spark):
    assert found(spark, ["[{'id': 1, 'name': b'A'}]"]) == [None]


def test_random_names(spark):
    draw = random.Random(1)
    names = ["".join(draw.choices("ab '\"\\\n\t,:{}[]()é😀\u0001 #", k=draw.randint(0, 8))) for _ in range(300)]
    texts = []
    for i, name in enumerate(names):
        spelled = draw.choice([repr, ascii, lambda n: "u" + repr(n), lambda n: f"{n[:2]!r} {n[2:]!r}"])(name)
        texts.append(draw.choice(["[{'id': %d, 'name': %s}]", "[{'name': %s, 'id': %d,}, None]"][:1]) % (i, spelled))
    assert found(spark, texts) == [[(str(i), name)] for i, name in enumerate(names)]
