"""Operator 3: personal data replaced by surrogates (DataFrame functions only).

Detection is one alternation of patterns: e-mail addresses, payment cards, social security numbers,
IPv4 addresses, telephone numbers, access keys, passwords and tokens, and titled names.  An entity is
(type, canonical form); e.g. digits alone for numbers, lower case for addresses.  A name has one or two
entities: its surname, and a given name within the surname and gender.

A surrogate is a function of an HMAC (the caller's key over type, canonical form and attempt number),
so an entity has the same surrogate wherever and however it is written (coreference): "+49 30 1234567"
and "+4930 1234567" get the same digits, "Mr. Smith" and "Mr. John Smith" the same surname.  Type and
format stay: digits are filled into the mention's own punctuation (a card keeps its first digit and
passes the Luhn test, a telephone number keeps its country code, an IPv4 address has octets in range),
secrets keep their alphabet and length, names keep title, gender, script, letter case and number of words.

Distinctness: all entities of the corpus are collected once (distinct rows, hashed to partitions).
Where two entities of a type would get the same surrogate, or a surrogate is itself an entity of the
corpus, the one with the larger canonical form makes another attempt, until no collision is left (an
error is raised only if their number stops falling, as for more entities than the format has values).
Attempts above 0 are the only thing looked up later: up to ``FEW`` of them travel as one map, and texts
are rewritten where they stand, without a shuffle; beyond that the mentions of the texts are joined
with the attempts and put back in order.

Defined results: null text stays null, text without entities stays as it is (both: n_entities 0).
Rows are independent, so null and repeated ids are no special case.  ``replace`` keeps all columns of
its input; its own columns have the prefix given.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FEW = 4096

# Detection patterns (Java regular expressions).
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET_NAME = r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api_?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?"
SECRET = SECRET_NAME + r"[A-Za-z0-9+/_.-]{7,}[A-Za-z0-9+/_-]"
ACCESS_KEY = r"\bAKIA[0-9A-Z]{16}\b"
CARD = r"(?<![\d.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?![\d-])"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])"
MALE, FEMALE = "Mr|Herr|Monsieur|Señor|Sr|господин", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа"
NAME = rf"(?<![\p{{L}}])(?:{MALE}|{FEMALE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
ANY = "|".join([EMAIL, SECRET, ACCESS_KEY, CARD, IP, SSN, PHONE, NAME])
#: A cheap test that every text with an entity passes (a test draws mentions from the patterns); the long pattern is tried on no other.
DIGITS, TITLE = r"\d{3}|\d\.\d{1,3}\.\d|\+\d", r"(?<![\p{L}])[MHFSг](?:rs?|s|iss|err|rau|onsieur|adame|me|eñora?|ra?|осподин|оспожа)\.? \p{Lu}"
# Given names and syllables of surnames, by gender and script.
GIVEN = {
    ("m", "latin"): "Adrian Bruno Carl Daniel Emil Felix Gustav Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul".split(),
    ("f", "latin"): "Alma Berta Clara Dora Emma Flora Greta Helena Ida Julia Karla Lena Marta Nora Olga Paula".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    ("f", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса".split(),
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke la le lo ma".split(), "cyrillic": "ба бе бо да де до ва ве га го ка ке ла ле ло ма".split()}
# Country calling codes of one and two digits; all others have three.
CODE_1, CODE_2 = "[17]", "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
TYPES = ("email", "access_key", "card", "ip", "ssn", "phone", "name", "secret")


def kind(m: Column) -> Column:
    """The type of a mention found by ``ANY``."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), "email").when(whole(ACCESS_KEY), "access_key").when(whole(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}"), "card")
        .when(whole(r"(?:\d{1,3}\.){3}\d{1,3}"), "ip").when(whole(r"\d{3}-\d{2}-\d{4}"), "ssn").when(whole(r"\+\d[\d ().-]+|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"), "phone")
        .when(m.rlike(rf"^(?:{MALE}|{FEMALE})\.? \p{{Lu}}"), "name").otherwise("secret")
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _name(m: Column) -> Column:
    return F.regexp_replace(m, r"^\S+ ", "")


def _female(m: Column) -> Column:
    return m.rlike(rf"^(?:{FEMALE})\.? ")


def _secret(m: Column) -> Column:
    return F.regexp_replace(m, f"^{SECRET_NAME}", "")


def _words(m: Column) -> Column:
    """The words of a name, in lower case."""
    return F.split(F.lower(_name(m)), " ")


def _gender(m: Column) -> Column:
    return F.when(_female(m), "f").otherwise("m")


def canonical(k: Column, m: Column) -> Column:
    plus = F.when(m.startswith("+"), F.concat(F.lit("+"), _digits(m))).otherwise(_digits(m))
    return F.when(k.isin("card", "ssn"), _digits(m)).when(k == "phone", plus).when(k == "email", F.lower(m)).when(k == "secret", _secret(m)).otherwise(m)


def entities(k: Column, m: Column) -> Column:
    """array<struct<t, c>>: the entities of a mention, type and canonical form."""
    one = lambda t, c: F.struct(t.alias("t"), c.alias("c"))
    words = _words(m)
    surname = one(F.lit("surname"), F.element_at(words, -1))
    given = one(F.lit("given"), F.concat_ws(" ", _gender(m), F.element_at(words, -1), F.element_at(words, 1)))
    return F.when(k != "name", F.array(one(k, canonical(k, m)))).when(F.size(words) > 1, F.array(surname, given)).otherwise(F.array(surname))


def _hex(key: str, *parts: Column) -> Column:
    """HMAC-SHA256 in hexadecimal digits."""
    raw = key.encode()
    raw = (raw if len(raw) <= 64 else hashlib.sha256(raw).digest()).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in raw).hex()))
    message = F.concat_ws("\x1f", *[p.cast("string") for p in parts]).cast("binary")
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256)


def _number(h: Column, at: int, size: int = 6) -> Column:
    """A whole number from hexadecimal digits of ``h``."""
    return F.conv(F.substring(h, at, size), 16, 10).cast("long")


def _fill(m: Column, digits: Column) -> Column:
    """The mention with its digits replaced one after another."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def put(s: Column, c: Column) -> Column:
        d = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["s"], F.when(d, F.substr(digits, s["i"], F.lit(1))).otherwise(c)).alias("s"), (s["i"] + d.cast("int")).alias("i"))

    return F.aggregate(F.filter(F.split(m, ""), lambda c: c != ""), start, put, lambda s: s["s"])


def _luhn(first15: Column) -> Column:
    """The digit that makes 15 digits pass the Luhn test."""
    d = lambda i: F.substr(first15, i, F.lit(1)).cast("int")
    double = lambda x: F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, double(d(i))).otherwise(d(i)))
    return ((10 - total % 10) % 10).cast("string")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` written and computed once, which keeps the plan small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _drawn(options: Column, n: Column, h: Column) -> Column:
    """``n`` of the options, by hexadecimal digits of ``h``."""
    at = lambda i: (F.conv(F.substr(h, 6 * i + 1, F.lit(6)), 16, 10).cast("long") % F.size(options) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(options, at(i)))


def _list(options: list[str]) -> Column:
    return F.split(F.lit(" ".join(options)), " ")


def _surname(c: Column, attempt: Column, key: str) -> Column:
    """A surname of four syllables, of up to ten in later attempts."""
    sounds = F.when(c.rlike(r"\p{IsCyrillic}"), _list(SYLLABLES["cyrillic"])).otherwise(_list(SYLLABLES["latin"]))
    return _let(_hex(key, F.lit("surname"), c, attempt), lambda h: F.initcap(F.array_join(_drawn(sounds, F.least(attempt + 4, F.lit(10)), h), "")))


def _given(c: Column, attempt: Column, key: str) -> Column:
    """A given name of the gender and script of ``c``, a double name in later attempts, then a triple one and so on."""
    of = F.concat(F.substring(c, 1, 1), F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin"))
    names = F.when(of == "fcyrillic", _list(GIVEN["f", "cyrillic"])).when(of == "mcyrillic", _list(GIVEN["m", "cyrillic"])).when(of == "flatin", _list(GIVEN["f", "latin"])).otherwise(_list(GIVEN["m", "latin"]))
    return _let(_hex(key, F.lit("given"), c, attempt), lambda h: F.array_join(_drawn(names, F.least(F.ceil(attempt / 2 + 1).cast("int"), F.lit(10)), h), "-"))


def _cased(word: Column, like: Column) -> Column:
    return F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(word)).otherwise(word)


def surrogate(k: Column, m: Column, attempts: Column, key: str) -> Column:
    """The replacement of mention ``m`` of type ``k``; ``attempts``: one for each of its entities.

    It depends on the canonical forms, and on the mention for its format alone.
    """

    def name(x: Column) -> Column:
        own = F.split(_name(x["m"]), " ")
        words = F.zip_with(F.reverse(x["e"]), F.reverse(F.slice(x["a"], 1, F.size(x["e"]))), lambda e, a: F.when(e["t"] == "surname", _surname(e["c"], a, key)).otherwise(_given(e["c"], a, key)))
        return F.concat(F.regexp_extract(x["m"], r"^\S+ ", 0), F.array_join(F.zip_with(words, own, _cased), " "))

    named = F.struct(m.alias("m"), entities(k, m).alias("e"), attempts.alias("a"))
    return F.when(k == "name", _let(named, name)).otherwise(_plain(k, m, F.get(attempts, 0), key))


def _plain(k: Column, m: Column, attempt: Column, key: str) -> Column:
    """The replacement of a mention that is no name."""

    def streams(x: Column) -> Column:
        h = [_hex(key, x["k"], x["c"], x["a"], F.lit(i)) for i in range(3)]
        # digits: uniform decimal digits, about 120
        return F.struct(x["k"].alias("k"), x["m"].alias("m"), x["c"].alias("c"), F.concat(h[0], h[1]).alias("h"), F.regexp_replace(F.concat(*h), "[a-f]", "").alias("d"))

    start = F.struct(k.alias("k"), m.alias("m"), canonical(k, m).alias("c"), attempt.alias("a"))
    return _let(start, lambda x: _let(streams(x), _rendered))


def _rendered(x: Column) -> Column:
    """The surrogate from type, mention, canonical form, hexadecimal and decimal digits."""
    k, m, c, h, digits = (x[n] for n in ("k", "m", "c", "h", "d"))
    card = F.concat(F.substring(c, 1, 1), F.substring(digits, 1, 14))
    prefix = F.regexp_extract(c, rf"^\+({CODE_1}|{CODE_2}|\d{{3}})", 1)
    phone = F.concat(prefix, (_number(h, 1) % 8 + 2).cast("string"), F.substring(digits, 1, 30))
    ip = F.concat_ws(".", (_number(h, 1) % 223 + 1).cast("string"), *[(_number(h, 1 + 6 * i) % 254 + 1).cast("string") for i in (1, 2, 3)])
    letters = F.translate(F.concat(h, h), "0123456789", "ghijklmnop")
    local = F.greatest(F.lit(6), F.instr(m, "@") - 1)
    email = F.concat(F.substr(letters, F.lit(1), local), F.lit("@mail"), (_number(h, 50) % 90 + 10).cast("string"), F.lit(".example.org"))
    upper = F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(h, 1, 16), "0189", "GHJK")))
    word = _secret(m)
    n = F.length(word)
    stream = F.repeat(h, F.ceil(n / 128).cast("int") + 1)
    alike = (
        F.when(word.rlike("^[0-9]+$"), F.translate(stream, "abcdef", "012345")).when(word.rlike("^[0-9a-f]+$"), stream).when(word.rlike("^[0-9A-F]+$"), F.upper(stream))
        .otherwise(F.translate(stream, "02468", "GHXYZ"))
    )
    secret = F.concat(F.substr(m, F.lit(1), F.length(m) - n), F.substr(alike, F.lit(1), n))
    return (
        F.when(k == "email", email).when(k == "card", _fill(m, F.concat(card, _luhn(card)))).when(k == "phone", _fill(m, phone)).when(k == "ssn", _fill(m, digits))
        .when(k == "ip", ip).when(k == "access_key", upper).otherwise(secret)
    )


def _mentions(text: Column) -> Column:
    hint = text.contains("@") | text.contains("=") | text.contains(":") | text.contains("AKIA") | text.rlike(DIGITS) | text.rlike(TITLE)
    return F.when(hint, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))


def made(t: Column, c: Column, m: Column, attempt: Column, key: str) -> Column:
    """The canonical form of an entity's surrogate; ``m``: any mention of it."""
    family = F.substring_index(c, " ", 2)
    return (
        F.when(t == "surname", F.lower(_surname(c, attempt, key)))
        .when(t == "given", F.concat_ws(" ", family, F.lower(_given(c, attempt, key))))
        .otherwise(canonical(t, _plain(t, m, attempt, key)))
    )


def attempts(docs: DataFrame, key: str, text: str = "text", patience: int = 20) -> DataFrame:
    """(type, canon, attempt) of the entities whose first surrogate collides; usually few or none."""
    found = docs.select(F.explode(_mentions(F.col(text))).alias("m")).select(F.explode(entities(kind(F.col("m")), F.col("m"))).alias("e"), "m").select("e.t", "e.c", "m")
    ents = cut(found.groupBy("t", "c").agg(F.min("m").alias("m")).withColumn("a", F.lit(0)))
    least, waited = None, 0
    while True:
        s = ents.withColumn("s", made(F.col("t"), F.col("c"), F.col("m"), F.col("a"), key))
        # the same canonical form twice: as surrogates of two entities, or as a surrogate and an entity
        own = s.select("t", F.col("s").alias("v"), "c", "m", "a", F.lit(1).alias("made"))
        real = s.select("t", F.col("c").alias("v"), F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("m"), F.lit(None).cast("int").alias("a"), F.lit(0).alias("made"))
        w = Window.partitionBy("t", "v").orderBy("made", "c")
        ranked = own.unionByName(real).withColumn("place", F.row_number().over(w)).filter("made = 1")
        ents = cut(ranked.select("t", "c", "m", (F.col("a") + (F.col("place") > 1).cast("int")).alias("a"), (F.col("place") > 1).alias("again")))
        clashes = ents.filter("again").count()
        ents = ents.drop("again")
        if not clashes:
            return ents.filter("a > 0").select(F.col("t").alias("type"), F.col("c").alias("canon"), F.col("a").alias("attempt"))
        least, waited = (clashes, 0) if least is None or clashes < least else (least, waited + 1)
        if waited > patience:
            raise ValueError(f"{clashes} surrogates still collide: a format has too few values for its entities")


def _weave(text: Column, found: Column, new: Column) -> Column:
    """The text with its mentions replaced in order."""
    gaps = F.split(text, ANY)
    return F.when(F.size(found) > 0, F.array_join(F.zip_with(gaps, new, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")).otherwise(text)


def replace(docs: DataFrame, key: str, text: str = "text", prefix: str = "_pii_", few: int = FEW) -> DataFrame:
    """``docs`` with surrogates in ``text``, and <prefix>types: the types of the replaced mentions in order."""
    late = attempts(docs, key, text)
    m, t = f"{prefix}m", f"{prefix}types"
    out = docs.withColumn(m, _mentions(F.col(text))).withColumn(t, F.transform(m, kind))
    n = late.limit(few + 1).count()
    if n <= few:
        first = lambda k, x: F.transform(entities(k, x), lambda e: F.lit(0))
        if n:
            table = late.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "type", "canon"), "attempt")))).scalar()
            out = out.withColumn(f"{prefix}late", table)
            first = lambda k, x: F.transform(entities(k, x), lambda e: F.coalesce(F.try_element_at(f"{prefix}late", F.concat_ws(" ", e["t"], e["c"])), F.lit(0)))
        new = F.zip_with(t, m, lambda k, x: surrogate(k, x, first(k, x), key))
        return out.withColumn(text, _weave(F.col(text), F.col(m), new)).select(*docs.columns, t)
    # many entities need other attempts: entities are joined with them, then put back by row and place
    row = f"{prefix}row"
    some = out.withColumn(row, F.xxhash64(*[F.col(c) for c in docs.columns]))
    each = some.filter(F.size(m) > 0).select(row, F.posexplode(F.arrays_zip(F.col(t).alias("k"), F.col(m).alias("m"))).alias("i", "x")).select(row, "i", F.col("x.k").alias("k"), F.col("x.m").alias("m")).distinct()
    part = each.select(row, "i", "k", "m", F.posexplode(entities(F.col("k"), F.col("m"))).alias("j", "e")).select(row, "i", "k", "m", "j", "e.t", "e.c")
    part = part.join(late, (F.col("t") == F.col("type")) & (F.col("c") == F.col("canon")), "left")
    each = part.groupBy(row, "i", "k", "m").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", F.coalesce("attempt", F.lit(0)).alias("a")))), lambda x: x["a"]).alias("a"))
    done = each.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", surrogate(F.col("k"), F.col("m"), F.col("a"), key).alias("s")))), lambda x: x["s"]).alias(f"{prefix}new"))
    done = some.filter(F.size(m) > 0).join(done, row).withColumn(text, _weave(F.col(text), F.col(m), F.col(f"{prefix}new"))).select(*docs.columns, t)
    return some.filter(F.size(m) == 0).select(*docs.columns, t).unionByName(done)


def query(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the text with surrogates, the number of mentions replaced, and their types in order."""
    out = replace(docs.select("doc_id", "text"), key)
    return out.select("doc_id", "text", F.size("_pii_types").cast("long").alias("n_entities"), F.col("_pii_types").alias("types"))
