"""Format-preserving pseudonyms of personal data: a keyed Feistel network over digit, letter and number vectors.

Everything is Spark SQL functions: a text is cut at the matches, each match is permuted within its format, and the parts
are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Vectors of more parts are hashed as a digest of their half, so that the work grows with their length alone.
LONG = 512
#: Dates are permuted within blocks of days that fill the years 1 to 9999 without a gap: one of 65 x 563 days, 49 of
#: 250 x 292 (one of them begins on 1900-01-01) and one of 64 x 601.
DATE_ORIGIN, FIRST_BLOCK, BLOCK, LAST_BLOCK, BLOCKS = "0001-01-01", (65, 563), (250, 292), (64, 601), 49
#: Country codes of one and of two digits; all others have three.
SHORT_CODES, TWO_DIGIT_CODES = "[17]", "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*+@(?:[A-Za-z0-9][A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9\-])"
_SECRET_NAME = r"(?i:(?<![a-z])(?:password|passwd|pwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)"
#: Up to white space or a quote; what follows the last letter or digit would stay as it is, and equal values shall be equal.
_SECRET = _SECRET_NAME + r"[^\s\"'`]{7,}[\p{L}\p{N}]"
_ACCESS_KEY = r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_ISO_DATE = r"(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])"
_DAY_DATE = r"(?<![0-9./])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9./])"
_SLASH_DATE = r"(?<![0-9./])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9./])"
_IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
_SSN = r"(?<![0-9\-])(?!000|666)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])"
_PHONE = r"(?<![0-9+(])(?:\+1[ .\-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .\-])[2-9][0-9]{2}[ .\-][0-9]{4}(?![0-9])"
_WORLD_PHONE = r"(?<![0-9+])\+[1-9](?:[ .\-/]?\(?[0-9]\)?){7,14}(?![0-9])"
_CARD = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"

#: In order of precedence: the first that matches at a place takes it.
KINDS = (
    ("email", _EMAIL),
    ("secret", _SECRET),
    ("access_key", _ACCESS_KEY),
    ("iban", _IBAN),
    ("iso_date", _ISO_DATE),
    ("day_date", _DAY_DATE),
    ("slash_date", _SLASH_DATE),
    ("ipv4", _IPV4),
    ("ssn", _SSN),
    ("phone", _PHONE),
    ("card", _CARD),
    ("world_phone", _WORLD_PHONE),
)
#: Characters that a kind can begin with; neighbours with the same ones are tried together, and most places fail at once.
_BEGINS = {"email": "A-Za-z0-9", "secret": "PpTtSsAa", "access_key": "A-Z", "iban": "A-Z"}


def _pattern() -> str:
    parts: list[tuple[str, list[str]]] = []
    for kind, pattern in KINDS:
        begins = _BEGINS.get(kind, "0-9+(")
        if not parts or parts[-1][0] != begins:
            parts.append((begins, []))
        parts[-1][1].append(pattern)
    return "|".join(f"(?=[{begins}])(?:{'|'.join(some)})" for begins, some in parts)


PATTERN = _pattern()
#: What any match holds at least one of.
_MARK = "[0-9@=:]|A[KS]IA"


def feistel(values: Column, radices: Column, key: str, domain: str) -> Column:
    """A permutation of the vectors `values` whose i-th part is below radices[i], for each key and domain.

    Halves take turns: each part of one is shifted, modulo its radix, by a keyed hash of the other half, the round and
    the place. A vector of one part has an empty other half and is shifted by a constant.
    """

    def turn(state: Column, number: Column, radices: Column) -> Column:
        middle = F.floor((F.size(state) + 1) / 2).cast("int")
        first = number % 2 == 0
        left, right = F.slice(state, F.lit(1), middle), F.slice(state, middle + 1, F.size(state) - middle)
        other = F.concat_ws(",", F.when(first, right).otherwise(left))
        seed = F.concat_ws("|", F.lit(key), F.lit(domain), F.size(state), number, other)
        seed = F.when(F.size(state) > LONG, F.sha2(seed, 256)).otherwise(seed)

        def shifted(value: Column, place: Column, seed: Column) -> Column:
            noise = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, place), 256), 1, 12), 16, 10).cast("bigint")
            return F.pmod(value + noise, F.element_at(radices, place + 1))

        # a variable of a lambda is computed once, an expression inside one for each part
        return F.flatten(F.transform(F.array(seed), lambda s: F.transform(state, lambda v, i: F.when((i < middle) == first, shifted(v, i, s)).otherwise(v))))

    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.flatten(F.transform(F.array(radices), lambda r: F.aggregate(turns, values, lambda state, number: turn(state, number, r))))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _is_digit(c: Column) -> Column:
    return (c >= "0") & (c <= "9")


def _is_upper(c: Column) -> Column:
    return (c >= "A") & (c <= "Z")


def _is_lower(c: Column) -> Column:
    return (c >= "a") & (c <= "z")


def permute_characters(text: Column, key: str, domain: str) -> Column:
    """Digits become digits, capitals capitals, small letters small letters; all else stays."""
    chars = _characters(text)
    base = lambda c: F.when(_is_digit(c), F.lit(48)).when(_is_upper(c), F.lit(65)).when(_is_lower(c), F.lit(97)).otherwise(F.lit(0))
    values = F.transform(chars, lambda c: F.when(base(c) > 0, F.ascii(c) - base(c)).otherwise(F.lit(0)).cast("bigint"))
    radices = F.transform(chars, lambda c: F.when(_is_digit(c), F.lit(10)).when(base(c) > 0, F.lit(26)).otherwise(F.lit(1)).cast("bigint"))
    out = feistel(values, radices, key, domain)
    return F.array_join(F.zip_with(chars, out, lambda c, v: F.when(base(c) > 0, F.char(v + base(c))).otherwise(c)), "")


def permute_digits(digits: Column, key: str, domain: str, radices: Column | None = None, offsets: Column | None = None) -> Column:
    """A string of digits as another of the same length. The i-th digit runs through radices[i] values from offsets[i] on."""
    chars = _characters(digits)
    offsets = F.transform(chars, lambda _: F.lit(0).cast("bigint")) if offsets is None else offsets
    radices = F.transform(chars, lambda _: F.lit(10).cast("bigint")) if radices is None else radices
    values = F.zip_with(chars, offsets, lambda c, o: c.cast("bigint") - o)
    return F.array_join(F.zip_with(feistel(values, radices, key, domain), offsets, lambda v, o: (v + o).cast("string")), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The sum whose last digit Luhn's rule looks at; places from the right of parity `doubled` count twice."""
    places = F.transform(F.reverse(_characters(digits)), lambda c, i: F.when(i % 2 == doubled, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x)


def is_luhn(digits: Column) -> Column:
    return _luhn_sum(digits, 1) % 10 == 0


def with_luhn(payload: Column) -> Column:
    return F.concat(payload, ((10 - _luhn_sum(payload, 0) % 10) % 10).cast("string"))


def iban_remainder(compact: Column) -> Column:
    """An IBAN without spaces, as a number modulo 97; valid ones give 1."""
    turned = _characters(F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4)))
    step = lambda a, c: F.when(_is_digit(c), (a * 10 + (F.ascii(c) - 48)) % 97).otherwise((a * 100 + (F.ascii(c) - 55)) % 97)
    return F.aggregate(turned, F.lit(0), step)


def _refill(shape: Column, digits: Column) -> Column:
    """The characters of shape with its digits replaced, in order, by those of digits."""
    return F.array_join(F.transform(_characters(shape), lambda c, i: F.when(_is_digit(c), F.substr(digits, F.length(F.regexp_replace(F.substr(shape, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), "")


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("bigint")


def _date(match: Column, pattern: str, key: str) -> Column:
    """A real date as another of the same block of days in the same format; other strings stay."""
    origin = F.lit(DATE_ORIGIN).cast("date")
    day = _long(F.datediff(F.to_date(F.try_to_timestamp(match, F.lit(pattern))), origin))
    head, size = FIRST_BLOCK[0] * FIRST_BLOCK[1], BLOCK[0] * BLOCK[1]
    number = F.floor((day - head) / size)
    by_block = lambda first, middle, last: _long(F.when(day < head, first).when(number < BLOCKS, middle).otherwise(last))
    a, b = (by_block(*(F.lit(x[i]) for x in (FIRST_BLOCK, BLOCK, LAST_BLOCK))) for i in (0, 1))
    base = by_block(F.lit(0), head + number * size, F.lit(head + BLOCKS * size))
    out = feistel(F.array(_long(F.floor((day - base) / b)), (day - base) % b), F.array(a, b), key, "date")
    moved = F.date_format(F.date_add(origin, (base + out[0] * b + out[1]).cast("int")), pattern)
    return F.when(day >= 0, moved).otherwise(match)


def _day_first(match: Column, key: str) -> Column:
    """A real date written day/month/year whose day exceeds 12 as another such one; other strings stay.

    So no result reads as month/day/year. Years move within their 200 (1900 to 2099 are one block; the first and the last
    block are shorter). Days 13 to 28 move among those of all months, 29 and 30 among those of all months but February,
    31 among the seven months that have it, 29 February among the leap years of its 400.
    """
    day, month, year = (_long(F.substring(match, at, n)) for at, n in ((1, 2), (4, 2), (7, 4)))
    real = F.to_date(F.try_to_timestamp(match, F.lit("dd/MM/yyyy"))).isNotNull() & (day > 12)
    base = F.when(year < 100, _long(1)).otherwise(F.floor((year - 100) / 200) * 200 + 100)
    years = _long(F.when(year < 100, 99).when(year >= 9900, 100).otherwise(200))
    text = lambda d, m, y: F.concat_ws("/", F.lpad(d.cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(y.cast("string"), 4, "0"))

    usual = feistel(F.array(year - base, month - 1, day - 13), F.array(years, _long(12), _long(16)), key, "day first")
    late = feistel(F.array(year - base, month - F.when(month > 1, 2).otherwise(1), day - 29), F.array(years, _long(11), _long(2)), key, "late day")
    longs = F.array(*(_long(m) for m in (1, 3, 5, 7, 8, 10, 12)))
    last = feistel(F.array(year - base, _long(F.array_position(longs, month)) - 1), F.array(years, _long(7)), key, "last day")
    cycle = year - 1 - (year - 1) % 400
    four = F.floor((year - cycle) / 4)  # from 1 to 100, of which all but 25, 50 and 75 are leap years
    rank = four - F.when(four > 75, 4).when(four > 50, 3).when(four > 25, 2).otherwise(1)
    leap = feistel(F.array(_long(rank)), F.array(_long(97)), key, "leap day")[0]
    again = leap + F.when(leap > 71, 4).when(leap > 47, 3).when(leap > 23, 2).otherwise(1)
    moved = (
        F.when((day == 29) & (month == 2), text(day, month, cycle + again * 4))
        .when(day == 31, text(day, F.element_at(longs, (last[1] + 1).cast("int")), base + last[0]))
        .when(day > 28, text(late[2] + 29, late[1] + F.when(late[1] > 0, 2).otherwise(1), base + late[0]))
        .otherwise(text(usual[2] + 13, usual[1] + 1, base + usual[0]))
    )
    return F.when(real, moved).otherwise(match)


def _digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def pseudonym(match: Column, key: str) -> Column:
    """What stands for one match of PATTERN."""
    is_kind = lambda k: match.rlike(f"^(?:{dict(KINDS)[k]})$")
    digits = _digits_of(match)

    local, host = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    labels, top = F.regexp_replace(host, r"\.[A-Za-z]+$", ""), F.regexp_extract(host, r"\.[A-Za-z]+$", 0)
    email = F.concat(permute_characters(local, key, "email"), F.lit("@"), permute_characters(labels, key, "host"), top)

    head = F.regexp_extract(match, f"^{_SECRET_NAME}", 0)
    secret_value = F.substr(match, F.length(head) + 1)
    secret = F.concat(head, permute_characters(secret_value, key, "secret"))

    access = F.concat(F.substring(match, 1, 4), permute_characters(F.substring(match, 5, 64), key, "access"))

    compact = F.regexp_replace(match, " ", "")
    inner = permute_characters(F.substring(compact, 5, 64), key, "iban")
    check = F.lpad((98 - iban_remainder(F.concat(F.substring(compact, 1, 2), F.lit("00"), inner))).cast("string"), 2, "0")
    new_iban = F.concat(F.substring(compact, 1, 2), check, inner)
    spaced = F.array_join(F.transform(_characters(match), lambda c, i: F.when(c == " ", c).otherwise(F.substr(new_iban, F.length(F.regexp_replace(F.substr(match, F.lit(1), i + 1), " ", "")), F.lit(1)))), "")
    iban = F.when(iban_remainder(compact) == 1, spaced).otherwise(match)

    octets = F.transform(F.split(match, r"\."), lambda x: x.cast("bigint"))
    network = (octets[0] >= 1) & (octets[0] <= 223)
    low = F.when(network, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    first = F.when(octets[0] == 0, F.lit(1)).when(network, F.lit(223)).otherwise(F.lit(32)).cast("bigint")
    base = F.when(octets[0] > 223, F.lit(224)).otherwise(low).cast("bigint")
    byte = F.lit(256).cast("bigint")
    moved = feistel(F.array(octets[0] - base, octets[1], octets[2], octets[3]), F.array(first, byte, byte, byte), key, "ipv4")
    ipv4 = F.concat_ws(".", moved[0] + base, moved[1], moved[2], moved[3])

    area = F.substring(digits, 1, 3).cast("bigint")
    parts = F.array(area - F.when(area > 666, 2).otherwise(1), F.substring(digits, 4, 2).cast("bigint") - 1, F.substring(digits, 6, 4).cast("bigint") - 1)
    social = feistel(parts, F.array(*(F.lit(x).cast("bigint") for x in (898, 99, 9999))), key, "ssn")
    new_area = social[0] + F.when(social[0] + 1 >= 666, 2).otherwise(1)
    ssn = F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((social[1] + 1).cast("string"), 2, "0"), F.lpad((social[2] + 1).cast("string"), 4, "0"))

    national = F.substring(digits, -10, 10)
    bounds = lambda a, b: F.array(*(F.lit(a if i in (0, 3) else b).cast("bigint") for i in range(10)))
    new_national = permute_digits(national, key, "phone", bounds(8, 10), bounds(2, 0))
    phone = _refill(match, F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), new_national))

    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    card = F.when(is_luhn(digits), _refill(match, with_luhn(permute_digits(body, key, "card")))).otherwise(match)

    code = F.when(digits.rlike(f"^{SHORT_CODES}"), 1).when(digits.rlike(f"^(?:{TWO_DIGIT_CODES})"), 2).otherwise(3)
    world = _refill(match, F.concat(F.substr(digits, F.lit(1), code), permute_digits(F.substr(digits, code + 1), key, "world")))

    return (
        F.when(F.contains(match, F.lit("@")) & is_kind("email"), email)
        .when(is_kind("secret"), secret)
        .when(is_kind("access_key"), access)
        .when(is_kind("iban"), iban)
        .when(is_kind("iso_date"), _date(match, "yyyy-MM-dd", key))
        .when(is_kind("day_date"), _date(match, "dd.MM.yyyy", key))
        .when(is_kind("slash_date"), F.when(F.substring(match, 1, 2) <= "12", _date(match, "MM/dd/yyyy", key)).otherwise(_day_first(match, key)))
        .when(is_kind("ipv4"), ipv4)
        .when(is_kind("ssn"), ssn)
        .when(is_kind("phone"), phone)
        .when(is_kind("card"), card)
        .when(is_kind("world_phone"), world)
        .otherwise(match)
    )


def pseudonymise_text(text: Column, key: str) -> Column:
    """The text with every match replaced: the pieces between matches and the pseudonyms, in turn."""
    pieces = F.split(text, PATTERN)
    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: pseudonym(m, key))
    return F.array_join(F.flatten(F.zip_with(pieces, found, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")


def pseudonymise(docs: DataFrame, key: str = "pagewright", text_col: str = "text") -> DataFrame:
    """docs with its text pseudonymised; all other columns and all rows stay.

    Mail addresses, IBANs, dates, IPv4 addresses, social-security and telephone numbers, card numbers, access keys and
    named secrets are replaced. Validity is kept: Luhn digits, IBAN check digits, calendar dates, country codes, number
    plans of North America. Equal values get equal pseudonyms in all documents, however their digits are spaced;
    different ones of a format stay different. What fails its check stays: dates that aren't in the calendar (years 1 to
    9999), IBANs by their remainder, digit runs by Luhn's rule. A date with slashes is month/day/year if its first number
    is 12 at most, else day/month/year, and is so afterwards. Null text stays null, empty text empty; texts of any length
    are done whole; repeated rows stay; an empty table gives no rows; other columns, whatever their names, are untouched.
    The key is a secret: who has it can revert the permutation.
    """
    marked = F.col(text_col).rlike(_MARK)
    return docs.withColumn(text_col, F.when(marked, pseudonymise_text(F.col(text_col), key)).otherwise(F.col(text_col)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
