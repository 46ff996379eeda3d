"""Detection, coreference, format and distinctness of surrogates."""

import hashlib
import hmac
import random
import re

import pytest
from loamweave.llm import surrogates as s
from pyspark.sql import functions as F


def run(spark, texts, **options):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in s.replace(d, "k", **options).orderBy("doc_id").collect()]


def test_hash_is_the_standard_hmac(spark):
    for key in ("k", "long " * 30):
        got = spark.range(1).select(s._hex(key, F.lit("a"), F.lit(3))).first()[0]
        assert got == hmac.new(key.encode(), b"a\x1f3", hashlib.sha256).hexdigest()


def drawn(rng):
    """Mentions of every pattern's shapes."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    sep = lambda: rng.choice(["", " ", ".", "-"])
    word = lambda n: "".join(rng.choice("abcXYZ019+/_.-") for _ in range(n)) + "q"
    return rng.choice([
        lambda: f"a{rng.choice('._%+-x')}b@h{rng.choice('-x')}.{rng.choice(['co.uk', 'de', 'info'])}",
        lambda: rng.choice(["password", "PWD", "api_key", "Token"]) + rng.choice(["=", ": ", ' = "', "':"]) + word(9),
        lambda: "AKIA" + "".join(rng.choice("ABC123") for _ in range(16)),
        lambda: rng.choice(["", " ", "-"]).join(d(4) for _ in range(4)),
        lambda: ".".join(str(rng.choice([0, 7, 10, 99, 255])) for _ in range(4)),
        lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: f"+{d(rng.randint(1, 3))}{rng.choice(['', ' ', '.', '-'])}{rng.choice(['%s', '(%s)']) % d(rng.randint(1, 4))}" + "".join(sep() + d(rng.randint(2, 4)) for _ in range(rng.randint(2, 4))),
        lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"]),
        lambda: rng.choice((s.MALE + "|" + s.FEMALE).split("|")) + rng.choice([" ", ". "]) + rng.choice(["Smith", "Éva Òr", "Иван Петров", "O'Neil"]),
    ])()


def test_the_cheap_test_rejects_no_mention(spark):
    rng = random.Random(4)
    texts = [rng.choice(["", "call ", "ab\n", "x, "]) + drawn(rng) + rng.choice(["", " today", ", y", "\n"]) for _ in range(3000)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    missed = d.filter((F.size(F.regexp_extract_all("text", F.lit(s.ANY), F.lit(0))) > 0) & (F.size(s._mentions(F.col("text"))) == 0))
    assert missed.count() == 0 and d.filter(F.size(s._mentions(F.col("text"))) > 0).count() > 2700


def test_one_entity_one_surrogate_in_any_format(spark):
    out = run(spark, ["+49 30 1234567", "+4930 1234567", "+49-30-1234567", "Mr. SMITH", "Mr. John Smith", "Mr. JOHN SMITH", "Mr Smith", "Mrs. Smith", "господин Иванов"])
    digits = {re.sub(r"\D", "", x) for x in out[:3]}
    assert len(digits) == 1 and digits.pop().startswith("49") and out[0].startswith("+49 ") and out[1][5] == " "
    surname = out[6].split()[1]
    assert out[3] == f"Mr. {surname.upper()}" and out[4].split()[-1] == surname and out[5] == "Mr. " + " ".join(out[4].split()[1:]).upper()
    assert out[7] == f"Mrs. {surname}" and surname != "Smith" and re.fullmatch("господин [А-Яа-я]+", out[8])


@pytest.mark.parametrize("few", [s.FEW, 0])
def test_many_given_names_of_one_family_stay_distinct(spark, few):
    names = [a + b for a in ("Al", "Be", "Cy", "Do", "Ed") for b in ("an", "bo", "co", "da", "el", "fi")]  # 30 for 16 names
    texts = [f"Mr. {n} Miller, Mr. Miller" for n in names] + ["no name", None]
    out = run(spark, texts, few=few)
    assert out[-2:] == ["no name", None]
    given = [re.match(r"Mr\. ([\w-]+) (\w+), Mr\. (\w+)$", x).groups() for x in out[:-2]]
    assert len({g for g, *_ in given}) == 30 and len({x for _, a, b in given for x in (a, b)}) == 1


def test_a_full_format_is_an_error(spark):
    with pytest.raises(ValueError, match="collide"):
        old, s.SYLLABLES["latin"] = s.SYLLABLES["latin"], ["la"]
        try:
            s.attempts(spark.createDataFrame([("Mr. " + x,) for x in "Aa Bb Cc Dd Ee Ff Gg Hh Ii Jj".split()], "text string"), "k", patience=1)
        finally:
            s.SYLLABLES["latin"] = old
