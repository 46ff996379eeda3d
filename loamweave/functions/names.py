"""Normalised forms of names and addresses, and the relations between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import lexicon as lx
from . import text as tx
from .ascii import ascii_lower


def folded(words: list[str]) -> list[str]:
    return sorted({w.replace("rn", "m").replace("l", "i") for w in words})


def _mapped(c: Column, table: dict[str, str]) -> Column:
    """The table's value, or the word itself."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def _without(words: Column, gone: list[str]) -> Column:
    return F.filter(words, lambda t: ~t.isin(gone))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def words(c: Column) -> Column:
    """The words of a space-joined string; null and '' have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda t: t != "")


def skeleton(c: Column) -> Column:
    """Consonants of a word, like sounds made equal, repeats collapsed."""
    for a, b in lx.SOUNDS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(c, "aeiouy", ""), r"(.)\1+", "$1")


def skeletons(c: Column) -> Column:
    """The words of a name as skeletons."""
    return _joined(F.transform(words(c), skeleton))


def _name_words(low: Column) -> Column:
    """Words of one name in lower-case ASCII: site names, marks and OCR mended, titles dropped, variants and look-alikes made equal."""
    site = rf"(?s)^(.*?)(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:{'|'.join(lx.SITE_ENDINGS)})\b(.*)$"
    c = F.regexp_replace(low, site, "$1 $2 $3")
    c = F.regexp_replace(F.regexp_replace(c, r"['’`.]", ""), r"\bm\s*/\s*s\b", " ")
    c = F.replace(F.replace(c, F.lit("&"), F.lit(" and ")), F.lit("/"), F.lit(" "))
    toks = F.transform(tx.tokens(c), tx.fix_ocr)
    toks = _without(toks, sorted({*folded(lx.HONORIFICS), *lx.HONORIFICS, *lx.MARKERS}))
    return F.array_distinct(F.transform(toks, lambda t: tx.fold(_mapped(t, lx.SRI | lx.VARIANTS))))


def with_names(df: DataFrame, name: str, prefix: str = "name_") -> DataFrame:
    """``df`` with <prefix>norm, core, compact, key and alt of a name column.

    norm: all words; core: without legal forms (norm, if none is left); compact: core without blanks;
    key: core without descriptors (core, if nothing or one word below 6 letters is left); alt: the
    other half of "X trading as Y" or "X | site", without legal forms.  A null name is an empty one.
    """
    ship(df.sparkSession)
    t = lambda n: f"_{prefix}{n}"
    alias = rf"(?is)^(.*?)\b(?:{'|'.join(lx.ALIASES)})\b(.*)$"
    raw = F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"(?i)\((?:id|ref|no)[^)]*\)|#\s*\d+", " ")
    out = df.withColumn(t("p"), F.split(raw, r" \| ", 2))
    main = F.regexp_replace(F.get(t("p"), F.lit(0)), r"(?<=\b[a-zA-Z])\.(?=[a-zA-Z]\b)", "")
    out = out.withColumn(t("m"), F.replace(main, F.lit("."), F.lit(" ")))
    after = F.regexp_extract(t("m"), alias, 2)
    split = F.trim(after) != ""
    out = out.withColumns({
        t("a"): ascii_lower(F.when(split, F.regexp_extract(t("m"), alias, 1)).otherwise(F.coalesce(F.get(t("p"), F.lit(1)), F.lit("")))),
        t("m"): ascii_lower(F.when(split, after).otherwise(F.col(t("m")))),
    }).withColumns({t("t"): _name_words(F.col(t("m"))), t("a"): _without(_name_words(F.col(t("a"))), folded(lx.LEGAL))})
    core = _without(F.col(t("t")), folded(lx.LEGAL))
    out = out.withColumn(t("c"), core).withColumn(t("k"), _without(F.col(t("c")), folded(lx.DESCRIPTORS)))
    thin = (F.size(t("k")) == 0) | ((F.size(t("k")) == 1) & (F.length(F.get(t("k"), F.lit(0))) < 6))
    out = out.withColumn(f"{prefix}norm", _joined(F.col(t("t")))).withColumn(f"{prefix}core", F.when(F.size(t("c")) > 0, _joined(F.col(t("c")))).otherwise(F.col(f"{prefix}norm")))
    key = F.when(~thin, _joined(F.col(t("k")))).otherwise(F.col(f"{prefix}core"))
    out = out.withColumns({f"{prefix}compact": F.replace(f"{prefix}core", F.lit(" "), F.lit("")), f"{prefix}key": key, f"{prefix}alt": _joined(F.col(t("a")))})
    return out.drop(*map(t, "pmatck"))


def _states(c: Column, country: Column) -> Column:
    """State names as codes, longest first, by the country's table; other countries keep theirs."""
    out = c
    for code, table in lx.STATES.items():
        chain = c
        for full in sorted(table, key=len, reverse=True):
            chain = F.regexp_replace(chain, rf"\b{full}\b", table[full])
        out = F.when(country == code, chain).otherwise(out)
    return out


def with_address(df: DataFrame, address: str, country: str, prefix: str = "addr_") -> DataFrame:
    """``df`` with <prefix>norm, nums (distinct numbers in string order) and key (norm without generic words)."""
    ship(df.sparkSession)
    t = lambda n: f"_{prefix}{n}"
    out = df.withColumn(t("l"), ascii_lower(F.col(address)))
    low = F.replace(F.regexp_replace(t("l"), r"['’`]", ""), F.lit("."), F.lit(" "))
    out = out.withColumn(t("l"), _joined(tx.tokens(low))).withColumn(t("l"), _states(F.col(t("l")), F.col(country)))
    apart = F.regexp_replace(t("l"), r"(?<![a-z0-9])([a-z]{1,4})([0-9]+)(?![a-z0-9])", "$1 $2")
    one = F.transform(words(apart), lambda x: _mapped(F.regexp_replace(x, r"^(\d+)(?:st|nd|rd|th)$", "$1"), lx.ORDINALS))
    one = F.transform(one, lambda x: F.when(x.rlike("^[0-9]+$"), F.regexp_replace(x, "^0+(?=[0-9])", "")).otherwise(_mapped(x, lx.STREETS | lx.CITIES)))
    out = out.withColumn(t("t"), F.array_distinct(_without(one, lx.ADDRESS_NOISE))).withColumn(f"{prefix}norm", _joined(F.col(t("t"))))
    return out.withColumns({f"{prefix}nums": _joined(tx.numbers(F.col(f"{prefix}norm"))), f"{prefix}key": _joined(_without(F.col(t("t")), lx.GENERIC))}).drop(t("l"), t("t"))


def records(df: DataFrame, name: str = "name", address: str = "address", country: str = "country") -> DataFrame:
    """Records with all normalised columns and the flag of a name outside Latin script."""
    return with_address(with_names(df, name), address, country).withColumn("non_latin", tx.non_latin(F.coalesce(F.col(name), F.lit(""))))


def families(norm: Column, table: dict[str, str]) -> Column:
    """The distinct families of the legal forms in a normalised name."""
    pairs = F.create_map(*[F.lit(x) for w, f in sorted({(folded([w])[0], f) for w, f in table.items()}) for x in (w, f)])
    return F.array_distinct(F.filter(F.transform(words(norm), lambda t: F.try_element_at(pairs, t)), lambda f: f.isNotNull()))


def legal_conflict(norm: Column, other_norm: Column, other_core: Column) -> Column:
    """Both carry legal forms, none in common; never where the other's core is one word (it may be initials)."""
    a, b = families(norm, lx.VETO_FAMILIES), families(other_norm, lx.VETO_FAMILIES)
    return (F.size(words(other_core)) >= 2) & (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def acronym(core: Column, compact: Column) -> Column:
    """The compact name is the initials of at least two words."""
    w = words(core)
    return (F.size(w) >= 2) & (F.array_join(F.transform(w, lambda t: F.substring(t, 1, 1)), "") == compact)


def near_numbers(a: Column, b: Column) -> Column:
    """Some two different numbers, two digits at least, of which one begins or ends with the other, that are at most 2 apart, or that differ in one of three or more digits."""
    value = lambda x: x.try_cast("decimal(38,0)")

    def near(x: Column, y: Column) -> Column:
        n = F.length(x)
        changed = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(x, i, F.lit(1)) != F.substr(y, i, F.lit(1))))
        parts = x.startswith(y) | x.endswith(y) | y.startswith(x) | y.endswith(x)
        apart = F.coalesce(F.abs(value(x) - value(y)) <= 2, F.lit(False))
        return (n >= 2) & (F.length(y) >= 2) & (x != y) & (parts | apart | ((n == F.length(y)) & (n >= 3) & (changed == 1)))

    return F.exists(a, lambda x: F.exists(b, lambda y: near(x, y)))


def first_number(norm: Column) -> Column:
    """The first word of digits alone, or ''."""
    return F.coalesce(F.get(F.filter(words(norm), lambda t: t.rlike("^[0-9]+$")), F.lit(0)), F.lit(""))


def _left_kind(a: Column, b: Column) -> Column:
    """How the closest two numbers of either side alone differ."""
    value = lambda x: x.try_cast("decimal(38,0)")
    digits = lambda w: F.array_sort(F.filter(w, lambda t: t.rlike("^[0-9]+$")))
    both = F.flatten(F.transform(digits(a), lambda x: F.transform(digits(b), lambda y: F.struct(F.abs(value(x) - value(y)).alias("d"), x.alias("x"), y.alias("y")))))
    best = F.get(F.array_sort(both), F.lit(0))
    kind = tx.number_kind(best["x"], best["y"])
    near = kind.isin("transposed", "one_digit_sub_small", "near_value") | (best["d"] <= 20)
    return F.when(best.isNull(), "other").when(kind.isin("zeros", "digit_added_or_lost", "one_digit_sub_big"), "typo").when(near, "neighbour").otherwise("far")


def number_relation(nums: Column, other_nums: Column, norm: Column, other_norm: Column) -> Column:
    """blank, no_num, same, overlap:subset, overlap:mixed_<kind> or conflict:<kind> of two addresses."""
    a, b = words(nums), words(other_nums)
    both = F.array_intersect(a, b)
    return (
        F.when(F.coalesce(other_norm, F.lit("")) == "", "blank").when((F.size(a) == 0) | (F.size(b) == 0), "no_num")
        .when((F.size(both) == F.size(a)) & (F.size(both) == F.size(b)), "same")
        .when((F.size(both) > 0) & ((F.size(both) == F.size(a)) | (F.size(both) == F.size(b))), "overlap:subset")
        .when(F.size(both) > 0, F.concat(F.lit("overlap:mixed_"), _left_kind(F.array_except(a, b), F.array_except(b, a))))
        .otherwise(F.concat(F.lit("conflict:"), tx.number_kind(first_number(norm), first_number(other_norm))))
    )
