"""PII surrogates with DataFrame functions only.

An entity is reduced to its identity (digits of a number, lower-case letters of an address, single names of a person), the identity
is replaced by a keyed one-to-one mapping of its kind, and the result takes the form of the entity: separators, case,
script, length, country, title. So one identity has one surrogate however it is written, and two identities never share
one. Listed first names go to first names of the same gender, listed surnames to surnames; check digits are made to fit.
"""

from __future__ import annotations

import hashlib
import random
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioq.llm.common import fresh, store

#: Common first names by gender, and surnames.
MALE = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Paul Mark George Peter Hans Karl Klaus Jürgen Wolfgang Stefan Jean Pierre Michel André Philippe Louis José Juan Carlos Luis Miguel Javier Pablo Иван Сергей Дмитрий Алексей".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Emily Anna Laura Ursula Monika Petra Sabine Renate Marie Nathalie Isabelle Sophie Camille Carmen Josefa Isabel Dolores Pilar Lucía Elena Ольга Наталья Анна Мария María".split()
SURNAMES = "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Martin Bernard Dubois Durand Moreau Laurent García Martínez López Sánchez Pérez Gómez Fernández Ruiz Иванов Смирнов Кузнецов Попов".split()


def with_plain(names: list[str]) -> list[str]:
    """Names with those that are the same without accents after them, as they are often typed."""
    bare = [unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", n) if c not in "\u0300\u0301\u0302\u0303\u0308\u0327")) if n[0] < "Ѐ" else n for n in names]
    return list(dict.fromkeys(names + bare))


MALE, FEMALE, SURNAMES = with_plain(MALE), with_plain(FEMALE), with_plain(SURNAMES)
TITLES = "Mr Mrs Ms Miss Herr Frau Monsieur Madame Señora Señor".split()
#: Characters that are exchanged among themselves; vowels and consonants apart, so that words stay pronounceable.
LATIN = ("aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæèéêëìíîïòóôõöøùúûüý", "çñðþßāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįĵķĺļľłńņňōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž")
CYRILLIC_GREEK = ("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψς")
#: First and last code point of letters of scripts without case, and of Armenian's small letters.
RANGES = ((0x0561, 0x0586), (0x05D0, 0x05EA), (0x0621, 0x063A), (0x0641, 0x064A), (0x0905, 0x0939), (0x0A95, 0x0AA8), (0x0E01, 0x0E2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
PLAIN = ("0123456789", *LATIN[:2])
#: Country calling codes by their first digits.
CALLING = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Letters of addresses beside ASCII: Latin, Greek and Cyrillic ones; scripts that are written without blanks would take their neighbours along.
WIDE = r"\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0370-\u03FF\u0400-\u04FF"
MAIL = rf"[A-Za-z0-9{WIDE}._%+-]"
HEX = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer around one double colon with a digit somewhere, so that qualified names in code are none.
GROUPS = rf"(?:{HEX}:){{7}}{HEX}|(?=[A-Fa-f:]{{0,39}}[0-9])(?=(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{0,4}}(?![0-9A-Za-z:])){HEX}(?::{HEX}){{0,5}}::(?:{HEX}(?::{HEX}){{0,5}})?"
STAMP = "(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:[01][0-9]|2[0-3])[0-5][0-9][0-5][0-9](?![0-9])"
WORD = r"\p{Lu}(?:\p{L}|['’-](?=\p{L})){1,40}"
TITLE = rf"(?:{'|'.join(TITLES + [t.upper() for t in TITLES])})\.?\x20"
#: Entity kinds in the order in which they are tried at a place. Phone numbers have 7 to 15 digits after a plus, or groups as
#: written in the United States, France, Spain and Germany, or are ten digits of the United States with nothing between them.
#: A name after a title may be of a script without capitals; a time of 14 digits is no card.
KINDS = {
    "email": rf"(?={MAIL})(?<!{MAIL}){MAIL}{{1,64}}+@[A-Za-z0-9{WIDE}-]{{1,63}}(?:\.[A-Za-z0-9{WIDE}-]{{1,63}}){{1,8}}",
    "ip": rf"(?=[0-9])(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?=[0-9A-Fa-f])(?<![0-9A-Za-z:.])(?:{GROUPS})(?![0-9A-Za-z:])",
    "iban": r"(?=[A-Z]{2}[0-9])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?=[0-9])(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "card": rf"(?=[0-9])(?<![0-9+])(?!{STAMP})[0-9](?:[\x20-]?[0-9]){{12,18}}(?![0-9])",
    "phone": r"(?=[0-9+(])(?:\+[0-9](?:[\x20.()/-]{0,2}[0-9]){6,14}|(?<![0-9+.-])(?!(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?:(?:\([0-9]{2,4}\)|0[0-9]{1,4}|[0-9]{3})(?:[\x20./-][0-9]{2,4}){2,5}|0[0-9]{2,4}[\x20/-][0-9]{5,8})|(?<![\w/=.+-])[2-9][0-9]{2}[2-9][0-9]{6}(?![\w/=]))(?![0-9]|[.-][0-9])",
    "name": rf"(?=[A-ZА-Я])(?<!\p{{L}})(?:{TITLE}(?:(?:(?:\p{{Lu}}\.|{WORD})\x20){{0,2}}{WORD}|\p{{Lo}}[\p{{Lo}}\p{{M}}]{{0,20}}(?:\x20\p{{Lo}}[\p{{Lo}}\p{{M}}]{{0,20}})?)|(?:{'|'.join(MALE + FEMALE)})\x20(?:\p{{Lu}}\.\x20)?{WORD})",
}
PATTERN = "|".join(KINDS.values())
#: Every entity has a match of this, which is cheaper to look for: most texts have none and are passed on.
QUICK = rf"@|[0-9A-Fa-f]:[0-9A-Fa-f]{{0,4}}:|[0-9](?:[^\p{{L}}]{{0,3}}[0-9]){{3}}|(?=[A-ZА-Я])(?:[A-Z]{{2}}[0-9]{{2}}|(?<!\p{{L}})(?:{'|'.join(TITLES + [t.upper() for t in TITLES] + MALE + FEMALE)})[.\x20])"


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern is the whole entity."""
    return reduce(lambda out, kind: out.when(entity.rlike(f"^(?:{KINDS[kind]})$"), kind), list(KINDS)[1:], F.when(entity.rlike(f"^(?:{KINDS['email']})$"), "email"))


def once(value: Column, use) -> Column:
    """use(value) with the value computed a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number(size: Column | int, key: str, *parts: Column) -> Column:
    """A keyed number below size that depends on all parts."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % size).cast("int")


def pass_over(chars: Column, key: str, salt: Column, names: bool, alphabets: tuple[str, ...]) -> Column:
    """Every character of a known alphabet moved within it by a keyed step that depends on those before it, so one-to-one."""

    def char(c: Column, i: Column) -> Column:
        def by(step: Column) -> Column:
            out = F.when(c == "", c)
            for letters in alphabets:
                at = F.instr(F.lit(letters), c)
                out = out.when(at > 0, F.substring(F.lit(letters), (at - 1 + step) % len(letters) + 1, F.lit(1)))
            for first, last in RANGES if names else ():
                n = last - first + 1
                moved_to = F.lit(first) + (F.ascii(c) - first + step % n) % n
                out = out.when(F.ascii(c).between(first, last), F.decode(F.unhex(F.lpad(F.hex(moved_to), 4, "0")), "UTF-16BE"))
            return out.otherwise(c)

        return once(number(1 << 30, key, salt, F.array_join(F.slice(chars, F.lit(1), i), "")), by)

    return F.transform(chars, char)


def moved(text: Column, key: str, salt: str, names: bool = False, alphabets: tuple[str, ...] = ()) -> Column:
    """A lower-case text or number over the same alphabets; forth and back, so that every character depends on every other."""
    alphabets = alphabets or ((*LATIN, *CYRILLIC_GREEK) if names else PLAIN)
    forth = once(F.split(text, ""), lambda c: F.reverse(pass_over(c, key, F.lit(salt + ">"), names, alphabets)))
    return F.array_join(F.reverse(once(forth, lambda c: pass_over(c, key, F.lit(salt + "<"), names, alphabets))), "")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def in_form(new: Column, old: Column, pattern: str) -> Column:
    """The characters of new, one for each of old that matches the pattern; all others of old stay where they are."""
    return once(F.split(old, ""), lambda c: F.array_join(F.transform(c, lambda x, i: F.when(x.rlike(pattern), F.substring(new, F.length(F.regexp_replace(F.array_join(F.slice(c, F.lit(1), i + 1), ""), f"[^{pattern[1:]}", "")), F.lit(1))).otherwise(x)), ""))


def like(new: Column, old: Column) -> Column:
    """The case of old on new: capitals throughout, by letter if the lengths agree, else by the first."""

    def cased(n: Column) -> Column:
        letters = F.array_join(F.transform(F.split(n, ""), lambda x, i: F.when(F.substring(old, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(x)).otherwise(x)), "")
        first = F.when(old.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, F.lit(2), F.length(n)))).otherwise(n)
        return F.when((F.length(old) > 1) & (old == F.upper(old)), F.upper(n)).when(F.length(n) == F.length(old), letters).otherwise(first)

    return once(new, cased)


def exchanged(names: list[str], key: str) -> dict[str, str]:
    """Every name of a list, in small letters, with another of its script: a keyed cycle."""
    out: dict[str, str] = {}
    for script in (lambda c: c < "Ѐ", lambda c: c >= "Ѐ"):
        part = sorted({n.lower() for n in names if script(n[0])})
        random.Random(hashlib.sha256(f"{key}\x1f{part}".encode()).digest()).shuffle(part)
        out |= dict(zip(part, part[1:] + part[:1], strict=True))
    return out


def one_name(token: Column, key: str) -> Column:
    """A single name: a listed one for a listed one, else as pronounceable as it was."""
    known = exchanged(SURNAMES, key) | exchanged(FEMALE, key) | exchanged(MALE, key)
    table = F.expr(f"map({', '.join(repr(x) for pair in known.items() for x in pair)})")

    def other(low: Column) -> Column:
        # a result that is a listed name moves on, so that it never meets the surrogate of a listed one
        return once(moved(low, key, "name", names=True), lambda x: F.when(F.map_contains_key(table, x), moved(x, key, "name", names=True)).otherwise(x))

    return once(F.lower(token), lambda low: like(F.coalesce(F.try_element_at(table, low), other(low)), token))


def person(entity: Column, key: str) -> Column:
    """Title and separators stay, every single name has its own surrogate, so a person keeps it with and without first name."""
    title = F.regexp_extract(entity, f"^{TITLE}", 0)
    rest = F.substring(entity, F.length(title) + 1, F.length(entity))
    names, between = F.regexp_extract_all(rest, F.lit(r"(\p{L}+)"), F.lit(1)), F.split(rest, r"\p{L}+", -1)
    parts = F.zip_with(between, F.transform(names, lambda n: one_name(n, key)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.concat(title, F.array_join(parts, ""))


def luhn(body: Column) -> Column:
    """The check digit of the digits before it."""
    doubled = F.transform(F.reverse(F.split(body, "")), lambda x, i: F.when(i % 2 == 0, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return (F.lit(10) - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10


def card(entity: Column, key: str) -> Column:
    """The first digit stays; the last is as far from the check digit as it was, so valid numbers stay valid."""

    def new(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), moved(F.substring(d, F.lit(2), n - 2), key, "card"))
        off = F.substring(d, n, F.lit(1)).cast("int") - luhn(F.substring(d, F.lit(1), n - 1))
        return once(body, lambda b: F.concat(b, ((luhn(b) + off + 10) % 10).cast("string")))

    return in_form(once(digits(entity), new), entity, "[0-9]")


def phone(entity: Column, key: str) -> Column:
    """Calling code and trunk zeros stay; the national number decides, so it reads alike with and without the code."""

    def new(d: Column) -> Column:
        code = F.when(entity.startswith("+"), F.regexp_extract(d, CALLING, 1)).otherwise("")
        zeros = F.regexp_extract(F.substring(d, F.length(code) + 1, F.length(d)), "^0*", 0)
        kept = F.length(code) + F.length(zeros)
        # the first digit of a national number is not zero
        first = F.substring(d, kept + 1, F.lit(1))
        rest = F.substring(d, kept + 2, F.length(d))
        return once(moved(rest, key, "phone"), lambda r: F.concat(code, zeros, F.when(first == "", "").otherwise(((first.cast("int") - 1 + number(9, key, F.lit("phone"), r)) % 9 + 1).cast("string")), r))

    return in_form(once(digits(entity), new), entity, "[0-9]")


def iban(entity: Column, key: str) -> Column:
    """The country stays, letters and digits keep their places, check digits are as far from the right ones as they were."""

    def right(country: Column, body: Column) -> Column:
        values = F.transform(F.split(F.concat(body, country, F.lit("00")), ""), lambda x: F.conv(x, 36, 10).cast("int"))
        return F.lit(98) - F.aggregate(values, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)

    def new(d: Column) -> Column:
        country, body = F.substring(d, 1, 2), F.substring(d, F.lit(5), F.length(d))
        off = F.substring(d, 3, 2).cast("int") - right(country, body)
        return once(F.upper(moved(F.lower(body), key, "iban")), lambda b: F.concat(country, F.lpad((F.pmod(right(country, b) + off - 2, F.lit(97)) + 2).cast("string"), 2, "0"), b))

    return in_form(once(F.replace(entity, F.lit(" "), F.lit("")), new), entity, "[A-Z0-9]")


def ssn(entity: Column, key: str) -> Column:
    """Area, group and serial each move within their valid numbers by steps that depend on the other two."""
    area, group, serial = (F.split_part(entity, F.lit("-"), F.lit(i)) for i in (1, 2, 3))
    index = area.cast("int") - 1 - F.when(area.cast("int") > 666, 1).otherwise(0)

    def part(x: Column, size: int, salt: str, *others: Column) -> Column:
        return (x + number(size, key, F.lit(salt), *others)) % size

    def rest(a: Column) -> Column:
        shown = F.lpad((a + 1 + F.when(a >= 665, 1).otherwise(0)).cast("string"), 3, "0")
        new_group = F.lpad((part(group.cast("int") - 1, 99, "ssn-group", shown, serial) + 1).cast("string"), 2, "0")
        return once(new_group, lambda g: F.concat_ws("-", shown, g, F.lpad((part(serial.cast("int") - 1, 9999, "ssn-serial", shown, g) + 1).cast("string"), 4, "0")))

    return once(part(index, 898, "ssn-area", group, serial), rest)


def address(entity: Column, key: str) -> Column:
    """Octets stay within 0 to 255; forth and back like the characters of a text."""

    def turn(octets: Column, salt: str) -> Column:
        return F.transform(octets, lambda x, i: ((x.cast("int") + number(256, key, F.lit(salt), F.array_join(F.slice(octets, F.lit(1), i), "."))) % 256).cast("string"))

    forth = once(F.split(entity, r"\."), lambda o: F.reverse(turn(o, "ip>")))
    return F.array_join(F.reverse(once(forth, lambda o: turn(o, "ip<"))), ".")


def hex_groups(entity: Column) -> Column:
    """The eight groups of an address of version 6 as numbers."""
    side = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(entity, "::", -1), F.lit(i)), F.lit("")), ":"), lambda x: x != "")
    return F.transform(F.concat(side(0), F.array_repeat(F.lit("0"), F.greatest(8 - F.size(side(0)) - F.size(side(1)), F.lit(0))), side(1)), lambda x: F.conv(x, 16, 10).cast("int"))


def long_address(entity: Column, key: str) -> Column:
    """Groups that are not zero move among those, forth and back, so zeros stay where they are, written out or not; letters keep their case if all are capitals."""

    def turn(groups: Column, salt: str) -> Column:
        return F.transform(groups, lambda x, i: F.when(x == 0, x).otherwise((x - 1 + number(65_535, key, F.lit(salt), F.array_join(F.slice(groups, F.lit(1), i), ":"))) % 65_535 + 1))

    def written(groups: Column) -> Column:
        shown = F.transform(F.reverse(groups), lambda x: F.lower(F.hex(x)))
        left = F.size(F.filter(F.split(F.split_part(entity, F.lit("::"), F.lit(1)), ":"), lambda x: x != ""))
        right = F.size(F.filter(F.split(F.split_part(entity, F.lit("::"), F.lit(2)), ":"), lambda x: x != ""))
        short = F.concat(F.array_join(F.slice(shown, F.lit(1), left), ":"), F.lit("::"), F.array_join(F.slice(shown, 9 - right, right), ":"))
        return F.when(F.contains(entity, F.lit("::")), short).otherwise(F.array_join(shown, ":"))

    forth = once(hex_groups(entity), lambda g: F.reverse(turn(g, "ipv6>")))
    out = once(once(forth, lambda g: turn(g, "ipv6<")), written)
    return F.when(entity.rlike("[A-F]") & (entity == F.upper(entity)), F.upper(out)).otherwise(out)


def email(entity: Column, key: str) -> Column:
    """The top domain stays; case doesn't matter for who it is, and is kept by letter."""
    low = F.lower(entity)
    top = F.regexp_extract(low, r"\.[^.]*$", 0)
    return like(F.concat(moved(F.substring(low, F.lit(1), F.length(low) - F.length(top)), key, "email", alphabets=(*PLAIN, *LATIN[2:], *CYRILLIC_GREEK)), top), entity)


def identity(entity: Column, kind: Column) -> Column:
    """What an entity is, however it is written: two entities with one identity have one surrogate but for form."""
    number_ = F.when(kind == "phone", F.regexp_replace(F.when(entity.startswith("+"), F.regexp_replace(digits(entity), CALLING, "")).otherwise(digits(entity)), "^0+", "")).otherwise(digits(entity))
    return F.when(kind.isin("card", "phone", "ssn"), number_).when(kind == "ipv6", F.array_join(hex_groups(entity), ":")).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).when(kind == "name", F.lower(F.regexp_replace(entity, f"^{TITLE}", ""))).otherwise(F.lower(entity))


def surrogate(entity: Column, key: str) -> Column:
    makers = {"email": email, "ip": address, "ipv6": long_address, "iban": iban, "ssn": ssn, "card": card, "phone": phone, "name": person}
    return once(kind_of(entity), lambda kind: reduce(lambda out, k: out.when(kind == k, makers[k](entity, key)), list(makers)[1:], F.when(kind == "email", email(entity, key))).otherwise(entity))


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def with_surrogates(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """Texts with every entity replaced, other columns kept; count_col, if given, gets the number of entities.

    Null texts stay null with zero entities; empty ones stay empty; very long ones are read whole. Rows are independent, so
    repeated rows agree. Letters of scripts without an alphabet here stay. A column already called count_col is replaced.
    """

    def replaced(found: Column) -> Column:
        between = F.split(F.col(text_col), PATTERN, -1)
        parts = F.zip_with(between, F.transform(found, lambda e: surrogate(e, key)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(F.col(text_col))

    found = F.when(F.col(text_col).rlike(QUICK), entities(F.col(text_col))).otherwise(F.array().cast("array<string>"))
    both = once(found, lambda found: F.struct(replaced(found).alias("text"), F.coalesce(F.array_size(found), F.lit(0)).cast("long").alias("n")))
    if count_col is None:
        return docs.withColumn(text_col, both["text"])
    pair = fresh("both", docs.columns)
    return docs.withColumn(pair, both).withColumns({text_col: F.col(f"{pair}.text"), count_col: F.col(f"{pair}.n")}).drop(pair)


def entity_map(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(kind, entity, surrogate, n, shared, real) of every distinct entity: the collision checks over a whole corpus.

    shared: another identity of the kind has the same surrogate, which must hold nowhere. real: the surrogate is itself an
    identity of the corpus. Null texts have no entities. The texts are read and the surrogates made once, then stored.
    """
    found = docs.filter(F.col(text_col).rlike(QUICK)).select(F.explode(entities(F.col(text_col))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))
    known = store(found.select(kind_of(F.col("entity")).alias("kind"), "entity", surrogate(F.col("entity"), key).alias("surrogate"), "n"))
    known = known.withColumn("_was", identity(F.col("entity"), F.col("kind"))).withColumn("_is", identity(F.col("surrogate"), F.col("kind")))
    known = store(known)
    taken = known.groupBy("kind", "_is").agg((F.min("_was") != F.max("_was")).alias("shared"))
    own = known.select("kind", F.col("_was").alias("_is"), F.lit(True).alias("real")).distinct()
    return known.join(taken, ["kind", "_is"]).join(own, ["kind", "_is"], "left").select("kind", "entity", "surrogate", "n", "shared", F.coalesce("real", F.lit(False)).alias("real"))
