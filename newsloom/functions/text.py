"""Text functions on columns: normalisation, tokens, facts, entities, language, markets, locales."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: JavaScript's word boundary and white space, spelled out: Java's know Unicode differently (fixed values).
JS_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
JS_S = r"[\s   -     　﻿]"
#: The characters of JS_S; runs of them that aren't a single blank already (fixed values).
JS_SPACES = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A printable ASCII character, which most are, is left at the first comparison.
_BEGIN = f"[[^!-~]&&{JS_S}]"
RUNS = f"{_BEGIN}(?:(?<! )|(?={_BEGIN})){JS_S}*+"
#: White space other than a blank: a text without it and without two blanks in a row has no run.
ODD = f"[[^ -~]&&{JS_S}]"
#: Kinds of facts in the order in which they are looked for; a later match never overlaps an earlier one (fixed values).
FACTS = [
    ("DATE_TIME", JS_B + r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{4})(?:[ T]\d{1,2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?" + JS_B),
    ("CURRENCY", r"(?iu)(?:[$€£]\s?\d[\d.,]*(?:\s?(?:million|billion|triệu|tỷ))?|" + JS_B + r"(?:USD|EUR|GBP|VND)\s?\d[\d.,]*(?:\s?(?:million|billion|triệu|tỷ))?|" + JS_B + r"\d[\d.,]*\s?(?:triệu|tỷ)\s?(?:đồng|VND)" + JS_B + ")"),
    ("PERCENTAGE", r"[+-]?\d+(?:[.,]\d+)?\s?%"),
    ("PRODUCT_VERSION", r"(?iu)" + JS_B + r"(?:GPT-?\d+(?:\.\d+)?|iPhone\s+\d+(?:\s+(?:Pro|Max|Plus))?|iOS\s+\d+(?:\.\d+)*|Android\s+\d+(?:\.\d+)*|v(?:ersion\s*)?\d+(?:\.\d+){1,3})" + JS_B),
    ("NUMBER", JS_B + r"\d+(?:[.,]\d+)?" + JS_B),
]
#: What a text must hold to have a match of the kind at all; few texts do, and looking costs little.
NEEDS = {"DATE_TIME": r"\d[-/]\d{1,2}[-/]\d", "CURRENCY": r"(?iu)[$€£]|USD|EUR|GBP|VND|triệu|tỷ", "PERCENTAGE": "%", "PRODUCT_VERSION": r"(?iu)GPT|iPhone|iOS|Android|v(?:ersion\s*)?\d", "NUMBER": r"\d"}
#: What a match of the kind begins with, looked at before the word boundary.
FIRST = {"DATE_TIME": r"(?=\d)", "NUMBER": r"(?=\d)"}
#: Words and patterns of claims (fixed values).
LEAD_WORDS = ["according", "the", "a", "an", "in", "on", "after", "before", "theo", "cập"]
PRODUCT_IDS = JS_B + r"(?:[A-Z]{2,}(?:-[A-Z0-9]+)*|GPT-?\d+(?:\.\d+)?|iPhone\s+\d+(?:\s+(?:Pro|Max|Plus))?|iOS\s+\d+)" + JS_B
NAMES = JS_B + r"\p{Lu}[\p{L}\d&.-]{2,}(?:[ \t]+\p{Lu}[\p{L}\d&.-]{1,}){0,4}"
PRODUCT = r"(?:GPT-?\d+(?:\.\d+)?|iPhone\s+\d+|iOS\s+\d+)"
NUMBERS, CAPITALISED = r"(?:\d{1,4}[.,:/-]?)+%?", JS_B + r"\p{Lu}[\p{L}\d]{2,}(?:\s+\p{Lu}[\p{L}\d]*)*"
#: The same matches in Java, where a greedy loop of a group calls itself at each turn: thousands of words or digits in a row would
#: overflow the stack, which ends the executor. Nothing that can fail follows the loops, so that they never go back.
JAVA_NUMBERS, JAVA_CAPITALISED = NUMBERS.replace(")+", ")++"), CAPITALISED + "+"
DIRECTIONS = r"(?iu)(?<!\p{L})(?:tăng|giảm|giữ nguyên|rise|rises|rose|increase|increased|fall|falls|fell|decrease|decreased|unchanged)(?!\p{L})"
CERTAINTY = r"(?iu)(?<!\p{L})(may|might|could|likely|unlikely|confirmed|dự kiến|có thể|nhiều khả năng|xác nhận)(?!\p{L})"
ATTRIBUTION = r"(?iu)(?:according to|theo)\s+([^,.;:]{2,120})"
VIETNAMESE = "ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
#: The same letters as a class that other letters leave at the first comparison.
MARKED = f"[\u00e0-\u1ef9&&[{VIETNAMESE}]]"


#: Ranges of characters that NFC or NFKC leave as they are (fixed values): none of them composes with another.
STABLE = {
    "NFC": r"\x00-\u02FF\u1EA0-\u1EF9\u2010-\u2027\u2030-\u205E\u20AC\u3400-\u4DBF\u4E00-\u9FFF",
    "NFKC": r"\x00-\x9F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u01A0\u01A1\u01AF\u01B0\u1EA0-\u1EF9\u2013\u2014\u2018-\u201A\u201C-\u201E\u20AC\u4E00-\u9FFF",
}


def _unicode(form: str):
    @F.pandas_udf(StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normal


def unicode_form(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form. Texts of characters that the form leaves as they are, alone and next to each other, stay in the
    JVM: the Python worker gets a null in their place."""
    same = F.rlike(text, F.lit(f"^[{STABLE['NFKC' if form in ('NFKC', 'NFKD') else 'NFC']}]*+$")) if form in ("NFC", "NFKC") else F.rlike(text, F.lit(r"^\p{ASCII}*+$"))
    return F.when(same, text).otherwise(_unicode(form)(F.when(~same, text)))


def js_trim(text: Column) -> Column:
    return F.trim(text, F.lit(JS_SPACES))


def semantic_text(text: Column, form: bool = True) -> Column:
    """NFC, line ends as LF, runs of blanks as one, none around line ends, at most one empty line, trimmed."""
    t = unicode_form(text) if form else text
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\t\f\x0B  ]+", " ")
    t = F.regexp_replace(t, r" +\n *|\n +", "\n")
    return js_trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def semantic_hash(title: Column, content: Column, form: bool = True) -> Column:
    return F.sha2(F.concat(semantic_text(F.coalesce(title, F.lit("")), form), F.lit("\n"), semantic_text(F.coalesce(content, F.lit("")), form)), 256)


def fingerprint(text: Column, form: bool = True) -> Column:
    """Lower-cased NFKC with all but letters, digits and % as single blanks."""
    t = unicode_form(text, "NFKC") if form else text
    return js_trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}%]+", " "))


def tokens(text: Column, least: int = 2, form: bool = True) -> Column:
    """Sorted distinct tokens of ``least`` or more characters."""
    return token_set(fingerprint(text, form), least)


def token_set(fp: Column, least: int = 2) -> Column:
    """The tokens of a fingerprint."""
    return F.sort_array(F.array_distinct(F.filter(F.split(fp, " "), lambda t: F.length(t) >= least)))


def invariants(text: Column) -> Column:
    """Sorted distinct number-like tokens and capitalised phrases."""
    numbers = F.regexp_extract_all(text, F.lit(JAVA_NUMBERS), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(r"(?=\p{Lu})" + JAVA_CAPITALISED), F.lit(0))
    return F.sort_array(F.array_distinct(F.concat(numbers, names)))


def compact(raw: Column) -> Column:
    return js_trim(F.regexp_replace(raw, RUNS, " "))


def normal_date(raw: Column) -> Column:
    """Bare dates day first, ISO times in UTC, others as they are."""
    d = lambda k: F.regexp_extract(raw, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", k)
    bare = F.concat(d(3), F.lit("-"), F.lpad(d(2), 2, "0"), F.lit("-"), F.lpad(d(1), 2, "0"), F.lit("T00:00:00.000Z"))
    iso = F.date_format(F.when(F.rlike(raw, F.lit(r"^\d{4}-")), F.try_to_timestamp(raw)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(d(3) != "", bare).otherwise(F.coalesce(iso, raw))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that one fold goes over: a fold copies what it has at every step.
CHUNK = 256


def places(widths: Column) -> Column:
    """The sum of all widths before each element: where pieces of such widths start, one after the other."""
    def run(w):
        chunk = lambda k: F.slice(w, k * CHUNK + 1, F.lit(CHUNK))
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x)
        running = lambda xs, first: F.aggregate(xs, F.array(first), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
        chunks = F.sequence(F.lit(0), F.floor((F.size(w) - 1) / CHUNK).cast("int"))
        firsts = running(F.transform(chunks, lambda k: total(chunk(k))), F.lit(0))
        inside = lambda first: lambda k: let(running(chunk(k), F.get(first, k)), lambda xs: F.slice(xs, F.lit(1), F.size(xs) - 1))
        return let(firsts, lambda first: F.flatten(F.transform(chunks, inside(first))))

    return let(widths, lambda w: F.when(F.size(w) > 0, run(w)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str) -> Column:
    """Array of (raw, start, end) of a pattern's matches, in characters."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("parts"))

    def run(s):
        starts = places(F.transform(s.found, lambda x, i: F.length(F.get(s.parts, i)) + F.length(x)))
        at = lambda st, i: (F.get(st, i) + F.length(F.get(s.parts, i))).cast("int")
        return let(starts, lambda st: F.transform(s.found, lambda x, i: F.struct(x.alias("raw"), at(st, i).alias("start"), (at(st, i) + F.length(x)).cast("int").alias("end"))))

    return let(both, run)


def facts(text: Column) -> Column:
    """Array of (kind, raw, normalized, start, end) in the order of the text: each kind is looked for in turn, and a match
    that overlaps one of an earlier kind is skipped."""
    def rows(kind, found):
        norm = normal_date if kind == "DATE_TIME" else compact
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.raw.alias("raw"), norm(m.raw).alias("normalized"), m.start.alias("start"), m.end.alias("end")))

    def clear_of(before):
        return lambda m: ~F.exists(before, lambda o: (m.start < o.end) & (o.start < m.end))

    def in_turn(s):
        taken = []
        for kind, _ in FACTS:
            free = s[kind]
            for before in taken:
                free = F.filter(free, clear_of(before))
            taken.append(free)
        return F.array_sort(F.concat(*[rows(k, f) for (k, _), f in zip(FACTS, taken, strict=True)]), lambda x, y: x.start - y.start)

    none = F.array().cast("array<struct<raw:string,start:int,end:int>>")
    found = [F.when(F.rlike(text, F.lit(NEEDS[kind])), matches(text, FIRST.get(kind, "") + pattern)).otherwise(none).alias(kind) for kind, pattern in FACTS]
    empty = F.array().cast("array<struct<kind:string,raw:string,normalized:string,start:int,end:int>>")
    # every kind holds a digit
    return F.when(F.rlike(text, F.lit(r"\d")), let(F.struct(*found), in_turn)).when(text.isNotNull(), empty)


def entities(text: Column) -> Column:
    """Acronyms, product ids and capitalised phrases of up to five words, distinct; phrases led by a stop
    word go, and so do phrases that mix a product id with other words."""
    ids = F.regexp_extract_all(text, F.lit("(?=[A-Zi])" + PRODUCT_IDS), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(r"(?=\p{Lu})" + NAMES), F.lit(0))
    lead = "^(?:" + "|".join(LEAD_WORDS) + ")(?: |$)"
    mixed = rf"(?iu){JS_B}{PRODUCT}{JS_B}.*\s|\s.*{JS_B}{PRODUCT}{JS_B}"
    keep = lambda e: ~F.rlike(F.lower(e), F.lit(lead)) & ~F.rlike(e, F.lit(mixed))
    return F.array_distinct(F.filter(F.transform(F.concat(ids, names), js_trim), keep))


def directions(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DIRECTIONS), F.lit(0)), F.lower))


def attribution(text: Column) -> Column:
    return F.nullif(js_trim(F.regexp_extract(text, ATTRIBUTION, 1)), F.lit(""))


def certainty(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, CERTAINTY, 1)), F.lit(""))


def sentences(text: Column) -> Column:
    """Array of (text, start, end) in characters, cut after . ! ? … and at line ends. An approximation of the
    ICU rules: abbreviations aren't known."""
    parts = F.split(text, r"(?<=[.!?…])(?=\s)|(?<=\n)")
    def one(p, at):
        lead = F.length(p) - F.length(F.ltrim(p, F.lit(JS_SPACES)))
        body = js_trim(p)
        return F.struct(body.alias("text"), (at + lead).cast("int").alias("start"), (at + lead + F.length(body)).cast("int").alias("end"))

    each = let(parts, lambda ps: let(places(F.transform(ps, F.length)), lambda at: F.transform(ps, lambda p, i: one(p, F.get(at, i)))))
    return F.filter(each, lambda x: x.text != "")


def claim_rows(docs, id_col: str = "content_id", text_col: str = "content"):
    """One row a sentence: its span, type, hash, facts, entities, directions, attribution, certainty."""
    s = docs.select(id_col, F.posexplode(sentences(F.col(text_col))).alias("position", "s")).select(id_col, "position", "s.*")
    t = F.col("text")
    return s.select(
        id_col, "position", "text", "start", "end", F.when(F.size(directions(t)) > 0, "DIRECTIONAL_STATEMENT").otherwise("FACTUAL_STATEMENT").alias("type"),
        F.sha2(js_trim(t), 256).alias("claim_hash"), facts(t).alias("facts"), F.array_distinct(F.concat(entities(t), F.array_compact(F.array(attribution(t))))).alias("entities"), directions(t).alias("directions"), attribution(t).alias("attribution"), certainty(t).alias("certainty"),
    )


def language(text: Column) -> Column:
    """``vi`` from three letters with Vietnamese marks on, else ``en``."""
    return F.when(F.regexp_count(F.lower(text), F.lit(MARKED)) >= 3, "vi").otherwise("en")


def language_confidence(text: Column, declared: Column) -> Column:
    n = F.regexp_count(text, F.lit(r"\p{L}"))
    marks = F.regexp_count(F.lower(text), F.lit(MARKED))
    found = language(text)
    signal = F.when(found == "vi", F.least(F.lit(1.0), 0.65 + marks / 20)).otherwise(0.9)
    return F.least(n / 80, signal) * F.when(found == declared, 1.0).otherwise(0.5)


def clean_html(html: Column) -> Column:
    """Tags and runs of blanks as single blanks, six entities decoded, trimmed; most texts have neither tags nor entities."""
    def clean(h):
        t = F.regexp_replace(h, "<[^>]+>", " ")
        for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
            t = F.replace(t, F.lit(a), F.lit(b))
        return F.when(F.contains(h, F.lit("<")) | F.contains(h, F.lit("&")), t).otherwise(h)

    runs = lambda x: F.contains(x, F.lit("  ")) | F.rlike(x, F.lit(ODD))
    return let(let(html, clean), lambda x: F.when(runs(x), compact(x)).otherwise(js_trim(x)))


def excerpt(text: Column) -> Column:
    return F.when(F.length(text) > 500, F.concat(F.substring(text, 1, 497), F.lit("..."))).otherwise(text)


def summary(text: Column) -> Column:
    """Up to 500 characters, cut after the last sentence end if that leaves 160 or more."""
    head = F.substring(text, 1, 500)
    cut = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(text) <= 500, text).when(F.length(cut) >= 160, cut).otherwise(js_trim(head))


def fold_accents(text: Column) -> Column:
    """NFD without combining marks, lower-cased; đ stays."""
    return F.lower(F.regexp_replace(unicode_form(text, "NFD"), "[̀-ͯ]", ""))


def locale(raw: Column, hans: bool = False) -> Column:
    """(locale, error): vi*, en*, zh-Hans and zh-CN/SG; zh-Hans is disabled unless ``hans``."""
    parts = F.split(F.lower(F.replace(F.trim(raw), F.lit("_"), F.lit("-"))), "-")
    lang = F.get(parts, F.lit(0))
    zh = (lang == "zh") & F.exists(parts, lambda p: p.isin("hans", "cn", "sg"))
    name = F.when(~F.coalesce(F.rlike(raw, F.lit(r"^\s*[A-Za-z]{2,3}([-_][A-Za-z0-9]{2,8})*\s*$")), F.lit(False)), None).when(lang == "vi", "vi").when(lang == "en", "en").when(zh, "zh-Hans")
    error = F.when(name.isNull(), "INVALID_LOCALE").when((name == "zh-Hans") & F.lit(not hans), "LOCALE_DISABLED")
    return F.struct(name.alias("locale"), error.alias("error"))


def market(raw: Column) -> Column:
    m = F.upper(F.trim(raw))
    return F.when(m.isin("VN", "GLOBAL", "US", "CN"), m)


def market_preferences(home: Column, followed: Column) -> Column:
    """(home_market, followed_markets, error, input): followed without home and repeats; the first bad value is reported."""
    h = market(home)
    good = F.transform(followed, market)
    bad = F.get(F.filter(followed, lambda x: market(x).isNull()), F.lit(0))
    any_bad = F.exists(good, lambda x: x.isNull())
    error = F.when(h.isNull(), "INVALID_HOME_MARKET").when(any_bad, "INVALID_FOLLOWED_MARKET")
    kept = F.when(error.isNull(), F.array_remove(F.array_distinct(good), h))
    return F.struct(F.when(error.isNull(), h).alias("home_market"), kept.alias("followed_markets"), error.alias("error"), F.when(h.isNull(), home).when(any_bad, bad).alias("input"))


def merged_markets(home: Column, followed: Column, new_home: Column, new_followed: Column) -> Column:
    """(home_market, followed_markets) of a profile after a patch whose parts can be null: the home market isn't followed."""
    h = F.coalesce(new_home, home)
    return F.struct(h.alias("home_market"), F.filter(F.array_distinct(F.coalesce(new_followed, followed)), lambda x: x != h).alias("followed_markets"))


def keywords(conditions: Column) -> Column:
    """Keywords of a watch rule's JSON: a string or an array under ``keywords``, or ``keyword``; blank ones go."""
    many = F.from_json(F.get_json_object(conditions, "$.keywords"), "array<string>")
    one = F.coalesce(F.get_json_object(conditions, "$.keywords"), F.get_json_object(conditions, "$.keyword"))
    raw = F.coalesce(F.when(F.get(many, F.lit(0)).isNotNull(), many), F.when(one.isNotNull() & ~one.startswith("["), F.array(one)), F.array().cast("array<string>"))
    return F.filter(F.transform(raw, lambda k: F.trim(k)), lambda k: k != "")
