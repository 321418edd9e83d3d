"""Personal data replaced by keyed, type-consistent surrogates.

Only DataFrame functions: one pattern finds e-mail addresses, phone and payment
card numbers and bank accounts (by their check digits), IPv4 and IPv6 addresses,
US social security numbers, credentials and persons' names. Names are found by a
title, by a common given name, or by their form (capitalised words) where a verb
of speech or meeting, a salutation or a signature is beside them; whoever is
found so once is found by form alone in every other text. Articles, words that begin
sentences and words of places and organisations (``NEVER``) are in no name. A given or
family name alone is found after a title only, and scripts other than Latin and Cyrillic not at all.

Each distinct entity of the whole table gets one surrogate, drawn from SHA-512 of
a secret key, its kind and its normal form, so an entity has the same surrogate
wherever and however it is written, and without the key nothing leads back. A
surrogate has the form of what it replaces: digits for digits, letters for
letters of the same case, separators, country code of phone numbers (of those without one the
first digit), card brand, check digits, private address ranges and top-level domain; names keep title, script
and gender (of common given names as listed, of others by their ending). The
parts of an entity that others share are entities of their own: domains of
addresses, given and family names.

Collision check: two entities of a kind never share a surrogate, and none is
equal to an entity of the table. Those that fail draw again; from the fourth draw
on, addresses, domains, credentials and names are longer, so they always find
room. Numbers can't be longer: where a form's whole space is nearly taken, so
that some of its entities still fail after ``ROUNDS`` draws, the entities of that
form pass on their values in a keyed order, each to the next, which can't collide
(the only case where a surrogate is another entity of the table).

Scale: entities are pulled out as (text digest, place, entity) rows; texts that
have none are never shuffled. A frequent entity or a much copied text is one row
after aggregation, and joins are split by AQE where they are skewed. A form whose
space is taken up has at most as many entities as its space has values.

The key comes from the caller or from ``spark.junctura.pii.key``; without both a
random one is drawn for the run, so that surrogates of two runs differ.

Defined cases: a null or empty text stays so; very long texts are read whole; a
null id passes like another; repeated rows stay, each replaced alike; an empty
table stays empty; all columns of the table stay, ``n_chars`` follows the new
text, and working names are prefixed with ``__``, so clashing names pass through.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import cut

ROUNDS, LONGER, FEW = 10, 4, 200_000
KEY = "spark.junctura.pii.key"

# Given names by script and gender, titles, words beside names, and syllables of made-up names.
GIVEN = {
    ("latin", "f"): (
        "Mary Patricia Jennifer Elizabeth Barbara Margaret Dorothy Charlotte Victoria Katherine Sophie Isabella Francesca Lucía Carmen Guadalupe Françoise Geneviève Brigitte Ursula Heidemarie Gretchen "
        "Emma Olivia Anna Maria Ana Laura Sarah Julia Linda Susan Karen Nancy Lisa Helen Emily Amanda Michelle Rebecca Rachel Hannah Alice Clara Marta Elena Isabel Teresa Marie Claire Camille Fatima Mei Yuki"
    ).split(),
    ("latin", "m"): (
        "James Robert Michael William David Richard Joseph Christopher Matthew Benjamin Nicholas Alexander Frederick José Francisco Alejandro François Jacques Wolfgang Jürgen Günther Friedrich "
        "John Thomas Charles Daniel Paul Andrew Peter George Kevin Brian Edward Henry Samuel Luis Carlos Juan Pedro Miguel Antonio Pierre Jean Hans Klaus Stefan Andreas Lukas Ahmed Mohammed Omar Wei Li Hiroshi"
    ).split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Екатерина Светлана Юлия".split(),
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Алексей Владимир Михаил Николай Иван Павел".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame".split()
BEFORE = "met told asked thanked called named interviewed conoció llamó traf fragte rencontra встретил встретила спросил спросила".split()
AFTER = "said says asked told wrote replied added explained met dijo preguntó escribió sagte fragte schrieb traf dit demanda écrivit сказал сказала спросил спросила написал написала встретил встретила".split()
AND = "and und y et и".split()
GREETING = "Dear Hello Hi Sincerely, Regards, Signed, Author: Name: Contact: From: Liebe Lieber Querida Querido Cher Chère".split()
# Words that no name has: articles and what begins a sentence, and words of places and organisations.
NEVER = (
    "The A An This That These Those When Then Later After Before But And Or If In On At Yesterday Today Der Die Das Den Dem Ein Eine Und Aber Wenn Im Am El La Los Las Un Una Pero Cuando Le Les Une Et Mais Quand "
    "New North South East West Saint House Street Avenue Road City Bank Banco Central University College School Hospital Museum Park River Lake Mountain Island Company Corporation Inc Ltd Group Press Times "
    "Microsoft Windows Google Apple Amazon Linux License Public General Union States Kingdom Republic Ministry Court Bundesbank Deutsche Deutscher Banque Universidad Universität Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "January February March April June July August September October November December"
).split()
# Country codes of two digits; 1 and 7 stand alone and all others have three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
SYLLABLES = {"latin": "bar den kel mor tal ven wick lan ros hart gil fen sto bel cor dun".split(), "cyrillic": "бар ден кел мор тал вен лан рос гил фен сто бел кор дун зар пол".split()}

_OCTET, _HEX = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)", "[0-9A-Fa-f]{1,4}"


def _any_of(words: list[str]) -> str:
    """Alternatives by first letter, so that few are tried at a place."""
    first: dict[str, list[str]] = {}
    for w in words:
        first.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items()) + ")"


_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:[-'’]?\p{Lu}\p{Ll}+)*+(?!\p{L})"
_NOT = rf"(?!{_any_of(NEVER)}(?!\p{{L}}))"
_WORD = _NOT + _NAME
_PERSON = rf"{_WORD}(?: {_WORD}){{1,2}}"
_COMPANY = rf"{_PERSON}(?: {_any_of(AND)} {_PERSON})?"
_TITLE, _GIVEN = _any_of(TITLES) + r"\.? ", _any_of([x for names in GIVEN.values() for x in names])
#: What an entity can start with, and the kinds that start so: elsewhere one look at a character is all it costs.
PATTERNS = {
    "": [r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9_%+\-][A-Za-z0-9._%+\-]*+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"],
    "[0-9A-Fa-f:]": [rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:|::(?:{_HEX}:){{1,6}}{_HEX})(?![\w:]|\.\d)"],
    "[0-9+(]": [
        r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)",
        r"(?<![\w(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)",
        r"(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])",
        r"(?<![\w(])\(0\d{2,4}\) ?\d{3,4}[ \-]?\d{3,4}(?![\w\-]| \d)",
        r"(?<![\w+.\-])0\d{2,4}[ \-]\d{3,4}[ \-]?\d{3,4}(?![\w\-]| \d)",
        r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])",
        rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
        r"(?<![\d.\-])\d(?:[ \-]?\d){12,18}(?!\d)",
    ],
    r"[A-ZÀ-ÖØ-ÞА-Я]": [
        r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        rf"(?<!\p{{L}})(?:{_TITLE})?{_GIVEN}(?: {_WORD}){{1,2}}",
        rf"(?<!\p{{L}}){_TITLE}{_NAME}(?: {_WORD}){{0,2}}",
        rf"(?<!\p{{L}}){_any_of(GREETING)} {_COMPANY}",
        rf"(?<!\p{{L}}){_COMPANY} {_any_of(AFTER)}(?!\p{{L}})(?: {_COMPANY})?",
        rf"(?<!\p{{L}}){_WORD} {_WORD}",
    ],
    "[" + "".join(sorted({w[0] for w in BEFORE})) + "]": [rf"(?<!\p{{L}}){_any_of(BEFORE)} {_COMPANY}"],
    "[pPtTsSaA]": [r"(?<![A-Za-z])(?i:password|passwd|pwd|token|secret|api[_\-]?key)\s{0,3}[=:]\s{0,3}\"?(?=[A-Za-z+/_.\-]*\d)[A-Za-z0-9+/_.\-]{8,}"],
}
PATTERN = "|".join((f"(?={start})" if start else "") + "(?:" + "|".join(kinds) + ")" for start, kinds in PATTERNS.items())
VALUE, FAMILY = r"([A-Za-z0-9+/_.\-]+)$", "(ов|ев|ин)а$"
#: Two capitalised words and nothing else: a name only if it is one elsewhere.
BY_FORM = rf"^{_NAME} {_NAME}$"
NO_NAME = rf"^(?:{_any_of(TITLES)}\.?|{_any_of(GREETING)})$"


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _kind(s: Column) -> Column:
    return (
        F.when(s.contains("@"), "email")
        .when(s.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ipv6")
        .when(s.rlike("^AKIA"), "secret")
        .when(s.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$"), "iban")
        .when(s.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(s.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(s.rlike(r"^[+(]|^\d{3}[.\-]\d{3}[.\-]\d{4}$|^0\d{2,4}[ \-]\d{3,4}[ \-]?\d{3,4}$"), "phone")
        .when(s.rlike(r"^\d"), "card")
        .when(s.rlike(rf"^(?:{_any_of(GREETING)} )?(?:{_TITLE})?{_NAME} ") | s.rlike(rf"^{_TITLE}") | s.rlike(rf"^{_any_of(BEFORE)} "), "name")
        .otherwise("secret")
    )


def _luhn(digits: Column) -> Column:
    """Sum by which a number with its check digit is a multiple of ten."""

    def add(a: Column, c: Column) -> Column:
        d = c.cast("int") * (1 + a["i"] % 2)
        return F.struct((a["i"] + 1).alias("i"), (a["s"] + F.when(d > 9, d - 9).otherwise(d)).alias("s"))

    return F.aggregate(_chars(F.reverse(digits)), F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")), add, lambda a: a["s"])


def _mod97(s: Column) -> Column:
    """Of an account number with letters as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(s), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _turned_account(s: Column) -> Column:
    return F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))


def _normal(kind: Column, s: Column) -> Column:
    digits, packed = F.regexp_replace(s, r"\D", ""), F.regexp_replace(s, " ", "")
    return (
        F.when(kind == "phone", F.concat(F.when(s.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "ssn", digits)
        .when(kind == "card", F.when(_luhn(digits) % 10 == 0, digits))
        .when(kind == "iban", F.when(_mod97(_turned_account(packed)) == 1, packed))
        .when(kind == "ipv6", F.when(s.rlike(r"\d") & (F.length(s) > 6), F.lower(s)))
        .when(kind == "secret", F.regexp_extract(s, VALUE, 1))
        .when(kind == "ip", s)
    )


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x01", F.lit(key), *parts, F.lit(key)), 512)


def _draw(h: Column, i: Column | int, below: int) -> Column:
    """A number under ``below`` from the i-th byte of the hash."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(h, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int") % below


def _like(s: Column, h: Column) -> Column:
    """Letters for letters, digits for digits, all else as it is; hexadecimal stays so."""
    hexed = s.rlike("^[0-9a-f:]*[0-9:][0-9a-f:]*$")

    def one(c: Column, i: Column) -> Column:
        letters = lambda low: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz" if low else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _draw(h, i, 26) + 1, F.lit(1))
        return (
            F.when(hexed & c.rlike("[a-f]"), F.substring(F.lit("abcdef"), _draw(h, i, 6) + 1, F.lit(1)))
            .when(c.rlike("[0-9]"), _draw(h, i, 10).cast("string"))
            .when(c.rlike("[a-z]"), letters(True))
            .when(c.rlike("[A-Z]"), letters(False))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(s), one), "")


def _digits(s: Column, h: Column, low: dict[int, tuple[int, int]], kept: int) -> Column:
    """Drawn digits for all but the first ``kept``; ``low``: (least, how many) at some places."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(i < kept, c)
        for at, (least, many) in low.items():
            out = out.when(i == at, (_draw(h, i, many) + least).cast("string"))
        return out.otherwise(_draw(h, i, 10).cast("string"))

    return F.array_join(F.transform(_chars(s), one), "")


def _kept(phone: Column) -> Column:
    """How many characters of a phone number stay: plus sign and country code, else the first digit."""
    code = F.when(F.substring(phone, 2, 1).isin("1", "7"), 2).when(F.substring(phone, 2, 2).isin(*TWO_DIGITS), 3).otherwise(4)
    return F.when(phone.startswith("+"), code).otherwise(1)


def _phone(norm: Column, h: Column) -> Column:
    kept = _kept(norm)

    def one(c: Column, i: Column) -> Column:
        return F.when(i < kept, c).when(i == kept, (_draw(h, i, 8) + 2).cast("string")).otherwise(_draw(h, i, 10).cast("string"))

    return F.array_join(F.transform(_chars(norm), one), "")


def _surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    h = _hash(key, kind, norm, attempt.cast("string"))
    more = F.when(attempt >= LONGER, F.array_join(F.transform(F.sequence(F.lit(LONGER), attempt), lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(h, i + 40, 26) + 1, F.lit(1))), "")).otherwise("")
    local = F.concat(_like(F.substring_index(norm, "@", 1), h), more)
    email = F.concat(local, F.lit("@"), F.substring_index(norm, "@", -1))
    domain = F.concat(_like(F.regexp_extract(norm, r"^(.*)\.[^.]+$", 1), h), more, F.lit("."), F.substring_index(norm, ".", -1))
    card = _digits(F.substring(norm, F.lit(1), F.length(norm) - 1), h, {}, 1)
    check = (10 - _luhn(F.concat(card, F.lit("0"))) % 10) % 10
    country, account = F.substring(norm, 1, 2), _like(F.substring(norm, F.lit(5), F.length(norm)), h)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    octet = lambda i: (_draw(h, i, 254) + 1).cast("string")
    ip = (
        F.when(norm.rlike(r"^(10|127)\."), F.concat_ws(".", F.substring_index(norm, ".", 1), octet(1), octet(2), octet(3)))
        .when(norm.rlike(r"^(192\.168|169\.254|172\.(1[6-9]|2\d|3[01]))\."), F.concat_ws(".", F.substring_index(norm, ".", 2), octet(2), octet(3)))
        .otherwise(F.concat_ws(".", (_draw(h, 0, 100) + 11).cast("string"), octet(1), octet(2), octet(3)))
    )
    secret = F.concat(F.when(norm.startswith("AKIA"), F.concat(F.lit("AKIA"), _like(F.substring(norm, F.lit(5), F.length(norm)), h))).otherwise(_like(norm, h)), more)

    def made(script: str, syllables: int, end: Column) -> Column:
        of = F.array(*map(F.lit, SYLLABLES[script]))
        n = F.lit(syllables) + attempt / 2  # later draws are longer, so there is always room
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.element_at(of, _draw(h, i, 16) + 1)), ""), end)

    cyrillic, woman = norm.rlike("[а-я]"), norm.rlike("[aáàаяé]$")
    family = F.when(cyrillic, made("cyrillic", 3, F.regexp_extract(norm, "(ов|ев|ин)$", 1))).otherwise(made("latin", 3, F.lit("")))
    given = F.when(cyrillic, made("cyrillic", 2, F.when(woman, "а").otherwise("")))
    return (
        F.when(kind == "email", email)
        .when(kind == "domain", domain)
        .when(kind == "phone", _phone(norm, h))
        .when(kind == "card", F.concat(card, check.cast("string")))
        .when(kind == "iban", iban)
        .when(kind == "ssn", _digits(norm, h, {0: (1, 5), 3: (1, 9), 5: (1, 9)}, 0))
        .when(kind == "ip", ip)
        .when(kind == "ipv6", _like(norm, h))
        .when(kind == "secret", secret)
        .when(kind == "given", given.otherwise(made("latin", 2, F.when(woman, "a").otherwise(""))))
        .otherwise(family)
    )


def _form(kind: Column, norm: Column) -> Column:
    """What numbers have in common with their surrogates."""
    range_ = F.regexp_extract(norm, r"^(10|127|192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))\.", 1)
    shape = F.translate(norm, "0123456789abcdefABCDEF", "0" * 10 + "a" * 6 + "A" * 6)
    return F.when(kind == "ip", range_).when(kind == "phone", F.concat(F.substring(norm, F.lit(1), _kept(norm)), F.lit(" "), F.length(norm).cast("string"))).when(kind == "card", F.concat(F.substring(norm, 1, 1), F.length(norm).cast("string"))).when(kind == "iban", F.concat(F.substring(norm, 1, 2), shape)).otherwise(shape)


def _given(key: str) -> Column:
    """The common given names along a keyed order of their own gender and script."""
    moved = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda x: hashlib.sha512(f"{key}\x01given\x01{x}".encode()).digest())
        moved |= dict(zip(order, order[1:] + order[:1], strict=True))
    return F.create_map(*[F.lit(x) for pair in moved.items() for x in pair])


def _written(kind: Column, s: Column, new: Column) -> Column:
    """The surrogate in the way that the entity was written."""

    def nth(c: Column, i: Column, out: str, of: str, skip: Column | int = 0) -> Column:
        """The character of ``new`` that stands for the i-th of ``s``, not counting what ``of`` leaves out."""
        n = F.length(F.regexp_replace(F.substring(s, F.lit(1), i + 1), of, "")) + skip
        return F.when(c.rlike(out), F.substring(new, n, F.lit(1))).otherwise(c)

    signed = F.when(new.startswith("+"), 1).otherwise(0)
    numbered = F.array_join(F.transform(_chars(s), lambda c, i: nth(c, i, "[0-9]", r"\D", signed)), "")

    cased = F.transform(_chars(new), lambda c, i: F.when(F.substring(s, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c))
    local = F.transform(_chars(F.substring_index(new, "@", 1)), lambda c, i: F.when(F.substring(s, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c))
    family = F.when(F.lower(s).rlike(FAMILY), F.concat(F.initcap(new), F.lit("а"))).otherwise(F.initcap(new))
    return (
        F.when(kind == "email", F.concat(F.array_join(local, ""), F.lit("@")))
        .when(kind.isin("domain", "ipv6"), F.array_join(cased, ""))
        .when(kind.isin("phone", "card", "ssn"), numbered)
        .when(kind == "iban", F.array_join(F.transform(_chars(s), lambda c, i: nth(c, i, "[^ ]", " ")), ""))
        .when(kind == "secret", F.concat(F.regexp_replace(s, VALUE, ""), new))
        .when(kind == "given", F.initcap(new))
        .when(kind == "name", family)
        .otherwise(new)
    )


def _parts(kind: Column, s: Column) -> Column:
    """A match as its entities and the text between them: array of (lead, s, kind, norm); a null norm is text."""

    def part(lead: Column, text: Column, of: Column, norm: Column) -> Column:
        return F.struct(lead.alias("lead"), text.alias("s"), of.alias("kind"), norm.alias("norm"))

    none = F.lit("")
    domain = F.substring_index(s, "@", -1)
    email = F.array(part(none, F.concat(F.substring_index(s, "@", 1), F.lit("@")), F.lit("email"), F.lower(s)), part(none, domain, F.lit("domain"), F.lower(domain)))
    words = F.split(s, " ")
    capital = lambda w: F.coalesce(w.rlike(r"^\p{Lu}") & ~w.rlike(NO_NAME), F.lit(False))

    def word(w: Column, i: Column) -> Column:
        of = F.when(~capital(w), "text").when(capital(F.get(words, i + 1)), "given").otherwise("name")
        norm = F.when(of == "given", F.lower(w)).when(of == "name", F.regexp_replace(F.lower(w), FAMILY, "$1"))
        return part(F.when(i > 0, " ").otherwise(""), w, of, norm)

    return F.when(kind == "email", email).when(kind == "name", F.transform(words, word)).otherwise(F.array(part(none, s, kind, _normal(kind, s))))


def detect(docs: DataFrame) -> DataFrame:
    """__text (digest), __at (number of the match in the text), __part, lead, s, kind, norm (null: text that isn't an entity)."""
    found = docs.select(F.md5("text").alias("__text"), F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("__at", "surface"))
    rows = found.distinct().withColumn("__kind", _kind(F.col("surface")))
    first = F.substring_index("surface", " ", 1)
    listed = first.isin(*[x for names in GIVEN.values() for x in names]) | first.rlike(NO_NAME)
    rows = cut(rows.withColumn("__by_form", (F.col("__kind") == "name") & F.col("surface").rlike(BY_FORM) & ~listed))
    # Persons that something beside them names, by each pair of given and family name.
    words = F.split("surface", " ")
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    sure = rows.where("__kind = 'name' AND NOT __by_form AND surface LIKE '% %'").select(F.explode(F.filter(pairs, lambda p: p.rlike(BY_FORM) & ~F.substring_index(p, " ", 1).rlike(NO_NAME))).alias("surface"))
    sure = cut(sure.distinct())
    sure = F.broadcast(sure) if sure.count() <= FEW else sure
    known = rows.where("__by_form").join(sure.withColumn("__known", F.lit(True)), "surface", "left")
    split = lambda d: d.select("__text", "__at", F.posexplode(_parts(F.col("__kind"), F.col("surface"))).alias("__part", "__p")).select("__text", "__at", "__part", "__p.*")
    plain = known.where("__known IS NULL").select("__text", "__at", F.lit(0).alias("__part"), F.lit("").alias("lead"), F.col("surface").alias("s"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("norm"))
    return split(rows.where("NOT __by_form")).unionByName(split(known.where("__known"))).unionByName(plain)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, norm) -> kind, norm, surrogate: distinct within a kind, and none of the entities."""
    all_ = entities.select("kind", "norm")
    drawn = lambda d: d.withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt")))
    now = cut(drawn(all_.withColumn("attempt", F.lit(0))))
    for round_ in range(ROUNDS + 1):
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "norm")).alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1")
        twice = now.join(first, ["kind", "surrogate"]).where(F.struct("attempt", "norm") != F.col("k")).select("kind", "norm")
        real = now.join(all_.withColumnRenamed("norm", "surrogate"), ["kind", "surrogate"], "left_semi").select("kind", "norm")
        bad = cut(twice.unionByName(real).distinct())
        if bad.isEmpty():
            return now.drop("attempt")
        if round_ == ROUNDS:
            break
        again = drawn(now.join(bad, ["kind", "norm"], "left_semi").withColumn("attempt", F.col("attempt") + 1).drop("surrogate"))
        now = cut(now.join(bad, ["kind", "norm"], "left_anti").unionByName(again.select(now.columns)))
    # Forms without room: their entities pass on their values, each to the next in a keyed order.
    full = bad.select("kind", _form(F.col("kind"), F.col("norm")).alias("form")).distinct()
    now = now.withColumn("form", _form(F.col("kind"), F.col("norm")))
    ring = Window.partitionBy("kind", "form")
    order = ring.orderBy(_hash(key, F.lit("ring"), F.col("kind"), F.col("norm")))
    passed = now.join(full, ["kind", "form"], "left_semi").select("kind", "norm", F.coalesce(F.lead("norm").over(order), F.first("norm").over(order)).alias("surrogate"))
    return now.join(full, ["kind", "form"], "left_anti").select("kind", "norm", "surrogate").unionByName(passed)


def secret_key(spark: SparkSession) -> str:
    """The key of ``spark.junctura.pii.key``; where it is not set a random one."""
    return spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY) or secrets.token_hex(32)


def replaced(docs: DataFrame, key: str | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced; ``count`` names a column for how many were."""
    key = key or secret_key(docs.sparkSession)
    found = cut(detect(docs))
    moved = F.element_at(_given(key), F.col("s"))
    listed = (F.col("kind") == "given") & moved.isNotNull()
    drawn, rest = found.where(F.col("norm").isNotNull() & ~F.coalesce(listed, F.lit(False))), found.where(F.col("norm").isNull() | F.coalesce(listed, F.lit(False)))
    table = surrogates(cut(drawn.select("kind", "norm").distinct()), key)
    new = drawn.join(table, ["kind", "norm"]).select("__text", "__at", "__part", F.concat("lead", _written(F.col("kind"), F.col("s"), F.col("surrogate"))).alias("__new"), F.lit(1).alias("__hit"))
    kept = rest.select("__text", "__at", "__part", F.concat("lead", F.when(listed, moved).otherwise(F.col("s"))).alias("__new"), F.coalesce(listed, F.lit(False)).cast("int").alias("__hit"))
    # Both groupings are by the text's digest, so rows move once.
    parts = new.unionByName(kept).repartition("__text").groupBy("__text", "__at").agg(F.sort_array(F.collect_list(F.struct("__part", "__new"))).alias("__p"), F.max("__hit").alias("__hit"))
    whole = parts.select("__text", "__at", F.array_join(F.col("__p.__new"), "").alias("__new"), "__hit")
    of = whole.groupBy("__text").agg(F.sort_array(F.collect_list(F.struct("__at", "__new"))).alias("__all"), F.sum("__hit").alias("__n"))
    hit = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    some = docs.where(hit).withColumn("__text", F.md5("text")).join(of.withColumnRenamed("__text", "__k"), F.col("__text") == F.col("__k"), "left")
    between = F.split(F.col("text"), PATTERN, -1)
    text = F.array_join(F.flatten(F.zip_with(between, F.concat(F.col("__all.__new"), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    some = some.withColumn("text", F.when(F.col("__n") > 0, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.when(F.col("__n") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    none = docs.where(~hit)
    if count:
        return none.withColumn(count, F.lit(0).cast("long")).unionByName(some.withColumn(count, F.coalesce("__n", F.lit(0)).cast("long")).select(*docs.columns, count))
    return none.unionByName(some.select(*docs.columns))
