"""PII [native]: keyed, type-consistent surrogates with collision checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, written

# What is detected, in order of precedence.
_SECRET_WORDS = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key"
_TITLES_F = "Mrs|Ms|Miss|Frau|Mme|Señora|Sra|Госпожа|г-жа"
_TITLES_M = "Mr|Herr|Señor|Sr|Господин|г-н"
_TITLES_N = "Dr|Prof"
_TITLE = rf"(?:{_TITLES_F}|{_TITLES_M}|{_TITLES_N})\.? "
_NAME = r"\p{Lu}[\p{L}'’-]+"
DETECTED = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}",  # a host has at most 127 labels
    "secret": rf"(?<=[=:\"' \t])(?=[A-Za-z0-9+/_-]{{8}})(?<=(?i:{_SECRET_WORDS})[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?)[A-Za-z0-9+/_-]{{8,}}",
    "aws": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "card": r"(?<![\w.-])(?:3[47]\d\d[ -]?\d{6}[ -]?\d{5}|[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?(?:\d{4}[ -]?\d{3}|\d{1,4}))(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+(])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![-.])\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "name": rf"(?<![\p{{L}}]){_TITLE}{_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in DETECTED.values())
_TITLED = r"(?:M(?:rs?|s|iss|me)|Frau|Herr|Señora?|Sra?|Dr|Prof|Госпо|г-)[\p{L}.]* \p{Lu}"
_PLAIN = ("email", "aws", "iban", "ipv6", "card", "ssn", "phone", "ipv4", "name")
# What surrogate names are made of; the last letters by gender.
SOUNDS = {"latin": ("b d f g k l m n p r s t v z dr st".split(), "aeiou"), "cyrillic": ("б д ф г к л м н п р с т в з др ст".split(), "аеиоу")}
ENDINGS = {"latin": {"given f": "a", "given m": "o", "given n": "e"}, "cyrillic": {"given f": "а", "given m": "ин", "given n": "е"}}
#: From this attempt on, formats with few digits get longer, so that a space of surrogates never ends.
GROW = 8


def _whole(value: Column, kind: str) -> Column:
    return value.rlike(f"^(?:{DETECTED[kind]})$")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mod97(iban: Column) -> Column:
    """The remainder of an account number, letters counting 10 to 35, its first four characters last."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _wrong_check(value: Column) -> Column:
    """Whether the value is formed like a card or account number, but its check digits are wrong."""
    card = _whole(value, "card") & ~F.call_function("luhn_check", F.regexp_replace(value, r"\D", ""))
    return card | (_whole(value, "iban") & (_mod97(F.replace(value, F.lit(" "), F.lit(""))) != 1))


def kind_of(value: Column, known: Column, secrets: Column) -> Column:
    """The type of a detected value.

    What looks like a card or account number but has wrong check digits is a plain "number", which is nobody's data,
    unless the text labels it as a secret. known are the names that the text gives a title elsewhere.
    """
    out = F.lit("secret")
    for k in reversed(_PLAIN):
        out = F.when(_whole(value, k), k).otherwise(out)
    wrong = F.when(F.array_contains(secrets, value), "secret").otherwise("number")
    return F.when(F.array_contains(known, value), "name").when(_wrong_check(value), wrong).otherwise(out)


def canonical(value: Column, kind: Column) -> Column:
    """The same for all spellings of one entity: emails and IPv6 without case, numbers without punctuation."""
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(value))
        .when(kind.isin("card", "ssn", "phone"), F.regexp_replace(value, r"\D", ""))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .otherwise(value)
    )


def _untitled(value: Column) -> Column:
    return F.regexp_replace(value, f"^{_TITLE}", "")


def parts_of(value: Column, known: Column, women: Column, men: Column, secrets: Column) -> Column:
    """(kind, canon) of the entities of a value: of a name its given and family name, each on its own, else one.

    A title tells the gender; without one (or with one of either gender) the text's other titles of that given name do.
    """

    def named(words: Column) -> Column:
        first, last = F.lower(F.get(words, F.lit(0))), F.lower(F.element_at(words, -1))
        woman = value.rlike(f"^(?:{_TITLES_F})\\.? ") | F.array_contains(women, first)
        man = value.rlike(f"^(?:{_TITLES_M})\\.? ") | F.array_contains(men, first)
        man = ~value.rlike(f"^(?:{_TITLES_F})\\.? ") & man
        gender = F.when(value.rlike(f"^(?:{_TITLES_M})\\.? "), "given m").when(woman, "given f").when(man, "given m").otherwise("given n")
        family = F.struct(F.lit("family").alias("kind"), last.alias("canon"))
        return F.when(F.size(words) > 1, F.array(F.struct(gender.alias("kind"), first.alias("canon")), family)).otherwise(F.array(family))

    one = lambda k: F.when(k == "name", _let(F.split(_untitled(value), " "), named)).otherwise(F.array(F.struct(k.alias("kind"), canonical(value, k).alias("canon"))))
    return _let(kind_of(value, known, secrets), one)


def _number(hexes: Column, at: Column | int, digits: int = 2) -> Column:
    """The number that hex digits at a place make (the stream is read in a ring)."""
    place = (F.lit(at) if isinstance(at, int) else at) % (128 - digits)
    return F.conv(F.substr(hexes, place + 1, F.lit(digits)), 16, 10).cast("int")


def _alphabet(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _chars(value: Column, put) -> Column:
    return F.array_join(F.transform(F.split(value, ""), put), "")


def _like(value: Column, stream: Column) -> Column:
    """Each letter and digit replaced by one of its class; hex with letters stays hex."""
    hexed = value.rlike("^[0-9a-f]*[a-f][0-9a-f]*$")
    return _chars(
        value,
        lambda c, i: F.when(hexed, _alphabet("0123456789abcdef", _number(stream, i, 1)))
        .when(c.rlike("[0-9]"), _alphabet("0123456789", _number(stream, 2 * i)))
        .when(c.rlike("[a-z]"), _alphabet("abcdefghijklmnopqrstuvwxyz", _number(stream, 2 * i)))
        .when(c.rlike("[A-Z]"), _alphabet("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _number(stream, 2 * i)))
        .otherwise(c),
    )


def _digits(n: Column | int, stream: Column, skip: int = 0) -> Column:
    """n digits, none for n < 1."""
    count = F.lit(n) if isinstance(n, int) else n
    each = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: (_number(stream, 2 * i + skip) % 10).cast("string"))
    return F.when(count > 0, F.array_join(each, "")).otherwise("")


def _luhn(body: Column) -> Column:
    """The check digit of a card number without it."""
    n = F.length(body)
    doubled = lambda d, i: F.when((n - i) % 2 == 1, F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    values = F.transform(F.split(body, ""), lambda c, i: doubled(c.cast("int"), i))
    return ((10 - F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def _said(stream: Column, count: Column, script: str) -> Column:
    """A word of so many syllables."""
    onset, vowel = SOUNDS[script]
    onsets = F.array(*map(F.lit, onset))
    syllable = lambda i: F.concat(F.get(onsets, _number(stream, 3 * i, 1)), _alphabet(vowel, _number(stream, 3 * i + 1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), count), syllable), "")


def _person(kind: Column, canon: Column, attempt: Column, s: Column) -> Column:
    def of(script: str) -> Column:
        ends = F.lit("")
        for k, x in ENDINGS[script].items():
            ends = F.when(kind == k, x).otherwise(ends)
        return F.concat(_said(s, F.when(kind == "family", 4).otherwise(3) + attempt, script), ends)

    return F.when(canon.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def surrogate(kind: Column, canon: Column, key: str, attempt: Column) -> Column:
    """The canonical form of an entity's replacement, from SHA-512 of key, kind, canonical form and attempt.

    Emails keep the shape of the local part and go to example domains; IPv4 addresses go to 240.0.0.0/4, IPv6
    addresses to 2001:db8::/32; card numbers keep their first digit, account numbers their country, both end
    in right check digits; phone numbers keep the country code; SSNs begin with 9; secrets keep length and
    character classes; names keep gender and script. Later attempts draw from larger spaces.
    """
    said = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"))
    return _let(F.sha2(said.cast("binary"), 512), lambda s: _made(kind, canon, attempt, s))


def _made(kind: Column, canon: Column, attempt: Column, s: Column) -> Column:
    text = lambda at, n: F.substr(s, F.lit(at + 1), F.lit(n))
    email = F.concat(_like(F.substring_index(canon, "@", 1), s), F.lit("@m"), text(100, 8), F.lit(".example."), F.get(F.array(F.lit("com"), F.lit("net"), F.lit("org")), _number(s, 110) % 3))
    ipv6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[text(40 + 4 * i, 4) for i in range(6)])
    ipv4 = F.concat_ws(".", (240 + _number(s, 0) % 15).cast("string"), *[_number(s, i).cast("string") for i in (2, 4, 6)])
    card = F.concat(F.substr(canon, F.lit(1), F.lit(1)), _digits(F.length(canon) - 2, s))
    country, account = F.substr(canon, F.lit(1), F.lit(2)), _like(F.substr(canon, F.lit(5)), s)
    iban = lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b)
    more = _digits(F.floor(attempt / GROW).cast("int"), s, 70)
    home = F.concat((2 + _number(s, 2) % 8).cast("string"), _digits(2, s, 10), F.lit("555"), _digits(4, s, 30))
    american = F.when(F.length(canon) == 10, home).when((F.length(canon) == 11) & canon.startswith("1"), F.concat(F.lit("1"), home))
    abroad = F.concat(F.substr(canon, F.lit(1), F.lit(2)), _digits(F.length(canon) - 2, s))
    return (
        F.when(kind == "email", email)
        .when((kind == "ipv6") | ((kind == "ipv4") & (attempt >= GROW)), ipv6)
        .when(kind == "ipv4", ipv4)
        .when(kind == "card", _let(card, lambda b: F.concat(b, _luhn(b))))
        .when(kind == "iban", _let(account, iban))
        .when(kind == "phone", F.concat(F.coalesce(american, abroad), more))
        .when(kind == "ssn", F.concat(F.lit("9"), _digits(8, s), more))
        .when(kind == "aws", F.concat(F.lit("AKIA"), _like(F.substr(canon, F.lit(5)), s)))
        .when(kind == "family", _person(kind, canon, attempt, s))
        .when(kind.startswith("given"), _person(kind, canon, attempt, s))
        .when(kind == "number", canon)
        .otherwise(F.concat(_like(canon, s), F.when(attempt > 0, F.substr(s, F.lit(60), 2 * attempt)).otherwise("")))
    )


def _dressed(value: Column, kind: Column, made: Column) -> Column:
    """The replacement in the value's format: its title and capitals, its punctuation between digits; what doesn't fit goes last."""
    slots = F.regexp_count(value, F.lit("[A-Z0-9]"))
    put = lambda core: _chars(value, lambda c, i: F.when(c.rlike("[A-Z0-9]"), F.substr(core, F.regexp_count(F.substr(value, F.lit(1), i + 1), F.lit("[A-Z0-9]")), F.lit(1))).otherwise(c))
    refilled = lambda core: F.concat(put(core), F.substr(core, slots + 1))
    name = F.concat(F.regexp_extract(value, f"^{_TITLE}", 0), F.array_join(F.transform(made, F.initcap), " "))
    first = F.get(made, F.lit(0))
    return F.when(kind == "family", name).when(kind.isin("card", "iban", "phone", "ssn"), refilled(first)).otherwise(first)


def scanned(df: DataFrame, text: str) -> DataFrame:
    """df with `_known`, `_women`, `_men`, `_secrets` and `_found`, the values of its text in order.

    Names are found by their titles first; a text that has any is searched again for the same names without
    title. Most texts have none of the characters that any value needs.
    """
    none = F.array().cast("array<string>")
    t = F.col(text)
    hint = t.rlike("[@0-9=:]") | F.contains(t, F.lit("AKIA")) | t.rlike(_TITLED)
    first = df.withColumn("_first", F.when(hint, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).otherwise(none))
    titled = first.withColumn("_titled", F.filter("_first", lambda v: v.rlike(f"^{_TITLE}")))
    tokens = F.transform("_titled", lambda v: F.split(_untitled(v), " "))
    given = lambda titles: F.transform(F.filter("_titled", lambda v: v.rlike(f"^(?:{titles})\\.? .* ")), lambda v: F.lower(F.get(F.split(_untitled(v), " "), F.lit(0))))
    full = F.transform(F.filter(tokens, lambda w: F.size(w) > 1), lambda w: F.array_join(w, " "))
    known = F.array_distinct(F.concat(full, F.transform(tokens, lambda w: F.element_at(w, -1))))
    some = F.size("_titled") > 0
    named = titled.select(
        *df.columns,
        "_first",
        F.when(some, known).otherwise(none).alias("_known"),
        F.when(some, given(_TITLES_F)).otherwise(none).alias("_women"),
        F.when(some, given(_TITLES_M)).otherwise(none).alias("_men"),
        F.when(F.exists("_first", _wrong_check), F.regexp_extract_all(t, F.lit(f"(?:{DETECTED['secret']})"), F.lit(0))).otherwise(none).alias("_secrets"),
    )
    again = F.when(F.size("_known") > 0, F.regexp_extract_all(t, pattern_of("_known"), F.lit(0))).otherwise(F.col("_first"))
    return named.withColumn("_found", again).drop("_first")


def pattern_of(known: str) -> Column:
    """PATTERN, and the names that the text gives a title elsewhere."""
    return F.concat(F.lit(PATTERN + r"|(?<![\p{L}'’-])(?:"), F.array_join(known, "|"), F.lit(r")(?![\p{L}'’-])"))


def _parts(value: Column) -> Column:
    return parts_of(value, F.col("_known"), F.col("_women"), F.col("_men"), F.col("_secrets"))


def detected_entities(df: DataFrame, text: str) -> DataFrame:
    """(k1, k2, kind, canon): the distinct entities of each distinct text, which k1 and k2 hash."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = scanned(df.select(t.alias("t")), "t").filter("size(_found) > 0")
    parts = F.array_distinct(F.flatten(F.transform("_found", _parts)))
    each = found.select(F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(7), "t").alias("k2"), F.explode(parts).alias("p"))
    return each.select("k1", "k2", "p.*").filter("kind <> 'number'").distinct()


def resolve_collisions(detected: DataFrame, key: str, max_rounds: int = 60) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate can't stand.

    A surrogate stands if no other entity of its type has it and it is no entity of the corpus itself. Of
    entities with equal surrogates the first in code point order keeps it, the others try again with the
    next attempt, until all stand. Only the number of entities that fell is brought to the driver.
    """
    n = n_partitions(detected.sparkSession)
    entities = written(detected.select("kind", "canon").distinct())
    known = entities.select("kind", F.col("canon").alias("made"), F.lit(True).alias("taken"))
    now = entities.withColumn("attempt", F.lit(0))
    for _ in range(max_rounds):
        made = surrogate(F.col("kind"), F.col("canon"), key, F.col("attempt"))
        tried = written(now.repartition(n, "kind", "canon").withColumn("made", made))  # few bytes but much work
        first = tried.groupBy("kind", "made").agg(F.min("canon").alias("holder"))
        judged = tried.join(first, ["kind", "made"]).join(known, ["kind", "made"], "left")
        fell = (F.col("canon") != F.col("holder")) | F.col("taken").isNotNull()
        now = written(judged.select("kind", "canon", (F.col("attempt") + fell.cast("int")).alias("attempt"), fell.alias("fell")))
        if not now.filter("fell").limit(1).count():
            return now.filter("attempt > 0").select("kind", "canon", "attempt")
        now = now.drop("fell")
    raise RuntimeError(f"surrogates still collide after {max_rounds} rounds")


def replace_entities(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df with the text's entities replaced, and `n_entities` (long), the number of replacements.

    The same entity gets the same surrogate in every text and spelling, different entities different ones.
    Given and family names are entities of their own, so all bearers of a family name keep one in common. A
    name is found by a title (Mrs., Herr, Dr. ...) and then replaced wherever that text has it, with or without
    title; names that no title in their text reveals stay. Numbers of cards and accounts with wrong check
    digits stay, unless labelled as a secret.

    Surrogates follow from key and entity, so no text is shuffled for them; only the rare entities whose first
    surrogate collided are looked up, by a join on the hash of the texts that hold them. Null and empty texts
    stay as they are; texts without entities keep every character; repeated rows are replaced alike; a column
    of df named n_entities is replaced; an empty table gives no rows.
    """
    base = df.drop("n_entities")
    detected = written(detected_entities(base, text))
    again = resolve_collisions(detected, key)
    entry = F.struct(F.concat("kind", F.lit(":"), "canon").alias("k"), F.col("attempt").alias("v"))
    held = detected.join(again, ["kind", "canon"]).groupBy("k1", "k2").agg(F.map_from_entries(F.collect_set(entry)).alias("_again"))
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = base.select("*", F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(7), t).alias("_k2"))
    maps = written(held.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}))
    joined = keyed.join(maps, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    attempt = lambda p: F.coalesce(F.try_element_at("_again", F.concat(p["kind"], F.lit(":"), p["canon"])), F.lit(0))
    made = lambda parts: F.transform(parts, lambda p: surrogate(p["kind"], p["canon"], key, attempt(p)))
    new = lambda v: _let(_parts(v), lambda parts: _dressed(v, F.element_at(parts, -1)["kind"], made(parts)))

    values = scanned(joined, text)
    between = F.split(F.col(text), F.when(F.size("_known") > 0, pattern_of("_known")).otherwise(PATTERN), -1)
    mixed = F.array_join(F.flatten(F.zip_with(between, F.concat(F.transform("_found", new), F.array(F.lit(""))), lambda p, m: F.array(p, m))), "")
    count = F.size(F.filter("_found", lambda v: F.array_contains("_known", v) | F.array_contains("_secrets", v) | ~_wrong_check(v)))
    out = values.withColumn("n_entities", F.greatest(count, F.lit(0)).cast("long"))
    return out.withColumn(text, F.when(F.size("_found") > 0, mixed).otherwise(F.col(text))).select(*base.columns, "n_entities")
