"""PII: format-preserving Feistel pseudonyms (DataFrame functions only).

Values are found by one pattern, validated, and permuted by a keyed Feistel
network inside the set of valid values of their format. A permutation gives equal
values equal pseudonyms in every document and different values different ones, and the
key can turn them back (``restore``). Kinds:

* card: 13 to 19 digits, plain or in groups of four, with a right Luhn digit; the digits
  before it are permuted and it is computed anew;
* date: yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy in the calendar from 1800 to 2199;
* IPv4 address, phone number (its ten last digits), US social security number;
* e-mail address (the part before @), access key, password and token after their
  marks: characters move within their class (digit, lower, upper, accented small or capital, hex, or
  another script's: small or capital Cyrillic and Greek, kana, Hangul, Han and others of ``_RANGES``).

Numbers are networks over mixed radix, so the domain is met exactly and no value
leaves it; strings are networks over their two halves. A round's function is SHA-256 of
key, kind, round and half. What fails validation stays as it is.

Texts without digit, @ and mark of a secret can hold no value and are passed
over; others are split at the pattern and put together again, so nothing else changes.
No shuffle takes place.

Defined results: null texts stay null, empty ones empty; equal rows are treated alike;
an empty table gives no rows; all columns are kept, ``text``, and ``n_chars`` if there is
one, follow; ``n_pseudonyms`` counts values replaced and takes the place of an
input column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relquery.llm.common import hidden, table

#: Where a session's configuration holds the key.
KEY_SETTING = "spark.relquery.pii.key"
#: The published key of the registered query on test tables; it protects nothing, and no operator takes it by itself.
SHOWN_KEY = "relquery-shown-key"
ROUNDS = 10

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
_SECRET = r"(?<![A-Za-z0-9])AKIA[A-Z2-7]{16}(?![A-Za-z0-9])|(?i:\bpassword\s?[=:]\s?)[A-Za-z0-9]{8,}|(?i:\b(?:token|secret|key)\s?[=:]\s?\"?)[0-9A-Fa-f]{24,}"
_DATE = r"(?<![\d./-])(?:\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\d/-])"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_PHONE = r"(?<![\d-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])"
_SSN = r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])"
_CARD = r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\d)"
PATTERN = "|".join((_EMAIL, _SECRET, _DATE, _IP, _PHONE, _SSN, _CARD))
_MARK = r"[=:](?<=(?i:password|token|secret|key)\s?[=:])"
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäçèéêëíîïñóôöùúûüß", "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ")
#: First and last letters of other classes: runs of letters of one kind, by code point.
_RANGES = ((0x0430, 0x045F), (0x0400, 0x042F), (0x03B1, 0x03C9), (0x0391, 0x03A1), (0x03A3, 0x03A9), (0x05D0, 0x05EA), (0x0620, 0x063A), (0x0905, 0x0939), (0x0E01, 0x0E2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
_DAYS, _DAY_A, _DAY_B = "1800-01-01", 189, 773  # 400 years have 189 * 773 days


def _prf(key: str, kind: str, i: Column, half: Column) -> Column:
    """SHA-256 of key, kind, round and half, in hex."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string"), F.lit(key)), 256)


def _number(x: Column, a: int, b: int, kind: str, key: str, back: bool) -> Column:
    """A permutation of 0 .. a * b - 1."""

    def noise(i: Column, half: Column) -> Column:
        return F.conv(F.substring(_prf(key, kind, i, half), 1, 15), 16, 10).cast("long")

    def size(i: Column) -> Column:
        return F.when(i % 2 == 1, F.lit(a)).otherwise(F.lit(b)).cast("long")

    def forth(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + noise(i, s["r"]) % size(i), size(i)).alias("r"))

    def undo(s: Column, i: Column) -> Column:
        return F.struct(F.pmod(s["r"] - noise(i, s["l"]) % size(i), size(i)).alias("l"), s["l"].alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, undo if back else forth, lambda s: s["l"] * b + s["r"])


def _digits(d: Column, key: str, kind: str, back: bool) -> Column:
    """A permutation of the digit strings of d's length (up to 18)."""
    left = F.floor(F.length(d) / 2).cast("int")

    def power(n: Column) -> Column:
        return F.pow(F.lit(10.0), n).cast("long")

    a, b = power(left), power(F.length(d) - left)

    def size(i: Column) -> Column:
        return F.when(i % 2 == 1, a).otherwise(b)

    def noise(i: Column, half: Column) -> Column:
        return F.conv(F.substring(_prf(key, kind, i, F.concat_ws("/", F.length(d).cast("string"), half.cast("string"))), 1, 15), 16, 10).cast("long")

    def forth(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + noise(i, s["r"]) % size(i), size(i)).alias("r"))

    def undo(s: Column, i: Column) -> Column:
        return F.struct(F.pmod(s["r"] - noise(i, s["l"]) % size(i), size(i)).alias("l"), s["l"].alias("r"))

    start = F.struct(F.substr(d, F.lit(1), left).cast("long").alias("l"), F.substr(d, left + 1).cast("long").alias("r"))
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, undo if back else forth, lambda s: F.concat(F.lpad(s["l"].cast("string"), left, "0"), F.lpad(s["r"].cast("string"), F.length(d) - left, "0")))


def _string(s: Column, key: str, kind: str, back: bool, classes: tuple[str, ...] = _CLASSES) -> Column:
    """A permutation of the strings with the same classes of characters in the same places."""
    left = F.floor(F.length(s) / 2).cast("int")

    def moved(half: Column, by: Column) -> Column:
        def one(c: Column, k: Column) -> Column:
            step = F.conv(F.substr(by, F.pmod(k, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            out = c
            for alphabet in classes[::-1]:
                at = F.call_function("instr", F.lit(alphabet), c)
                to = F.pmod(at - 1 + (-step if back else step), F.lit(len(alphabet))) + 1
                out = F.when((at > 0) & (c != ""), F.substr(F.lit(alphabet), to, F.lit(1))).otherwise(out)
            if classes is not _CLASSES:
                return out
            # the steps of one byte would reach 256 letters of a long run, so two bytes are taken here
            far = F.conv(F.substr(by, F.pmod(k, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code, moved_to = F.ascii(c), F.lit(None).cast("int")
            for first, last in _RANGES:
                moved_to = F.when(code.between(first, last), F.pmod(code - first + (-far if back else far), F.lit(last - first + 1)) + first).otherwise(moved_to)
            other = F.decode(F.unhex(F.lpad(F.hex(moved_to), 4, "0")), "UTF-16BE")
            return F.when(code > 255, F.coalesce(other, out)).otherwise(out)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def forth(x: Column, i: Column) -> Column:
        return F.struct(x["r"].alias("l"), moved(x["l"], _prf(key, kind, i, x["r"])).alias("r"))

    def undo(x: Column, i: Column) -> Column:
        return F.struct(moved(x["r"], _prf(key, kind, i, x["l"])).alias("l"), x["l"].alias("r"))

    start = F.struct(F.substr(s, F.lit(1), left).alias("l"), F.substr(s, left + 1).alias("r"))
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, undo if back else forth, lambda x: F.concat(x["l"], x["r"]))


def _refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order."""

    def one(c: Column, k: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substr(template, F.lit(1), k + 1), r"\D", ""))
        return F.when(c.rlike(r"^\d$"), F.substr(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(template, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The sum that a right check digit makes a multiple of ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: str, back: bool) -> Column:
    d = F.regexp_replace(m, r"\D", "")
    body = _digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", back)
    whole = F.get(F.transform(F.array(body), lambda x: F.concat(x, F.pmod(-_luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string"))), F.lit(0))
    return F.when(_luhn(d) % 10 == 0, F.get(F.transform(F.array(whole), lambda x: _refill(m, x)), F.lit(0))).otherwise(m)


def _date(m: Column, key: str, back: bool) -> Column:
    out = m
    for like, form in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d\d\.", "dd.MM.yyyy"), (r"^\d\d/", "dd/MM/yyyy")):
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(_DAYS).cast("date"))
        moved = F.date_format(F.date_add(F.lit(_DAYS).cast("date"), _number(day, _DAY_A, _DAY_B, "date", key, back).cast("int")), form)
        out = F.when(m.rlike(like), F.when(day.between(0, _DAY_A * _DAY_B - 1), moved).otherwise(m)).otherwise(out)
    return out


def _ip(m: Column, key: str, back: bool) -> Column:
    parts = F.split(m, r"\.")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    moved = F.array(_number(value, 1 << 16, 1 << 16, "ip", key, back))
    return F.get(F.transform(moved, lambda x: F.concat_ws(".", *[F.shiftright(x, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])), F.lit(0))


def _phone(m: Column, key: str, back: bool) -> Column:
    d = F.regexp_replace(m, r"\D", "")
    keep = F.length(d) - 10
    return _refill(m, F.concat(F.substr(d, F.lit(1), keep), _digits(F.substr(d, keep + 1), key, "phone", back)))


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)
    value = ((area - F.when(area < 666, 1).otherwise(2)) * 99 + group - 1).cast("long") * 9999 + serial - 1
    moved = F.array(_number(value, 898 * 99, 9999, "ssn", key, back))

    def text(x: Column) -> Column:
        front = F.floor(x / 9999).cast("int")
        a = F.floor(front / 99).cast("int") + 1
        a = F.when(a < 666, a).otherwise(a + 1)
        return F.concat(F.lpad(a.cast("string"), 3, "0"), F.lit("-"), F.lpad((front % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((x % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, F.get(F.transform(moved, text), F.lit(0))).otherwise(m)


def _secret(m: Column, key: str, back: bool) -> Column:
    mark = F.regexp_extract(m, r"^(?:AKIA|.*[=:]\s?\"?)", 0)
    rest = F.substr(m, F.length(mark) + 1)
    base32 = _string(rest, key, "access key", back, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",))
    lower, upper = (_string(rest, key, kind, back, (a,)) for kind, a in (("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF")))
    moved = F.when(mark == "AKIA", base32).when(rest.rlike("^[0-9a-f]+$"), lower).when(rest.rlike("^[0-9A-F]+$"), upper).otherwise(_string(rest, key, "word", back))
    return F.concat(mark, moved)


def _email(m: Column, key: str, back: bool) -> Column:
    at = F.instr(m, "@")
    return F.concat(_string(F.substr(m, F.lit(1), at - 1), key, "email", back), F.substr(m, at))


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a string that the pattern found."""
    kinds = ((r"^[^@\s]+@", _email), (rf"^(?:{_DATE})$", _date), (rf"^(?:{_IP})$", _ip), (rf"^(?:{_SSN})$", _ssn), (rf"^(?:{_CARD})$", _card), (rf"^(?:{_PHONE})$", _phone))
    out = _secret(m, key, back)
    for like, make in kinds[::-1]:
        out = F.when(m.rlike(like), make(m, key, back)).otherwise(out)
    return out


def _maybe(text: Column) -> Column:
    """Whether the pattern can find a value: all but secrets hold a digit or @, and secrets their marks."""
    return text.rlike(r"[0-9@]") | text.contains("AKIA") | text.rlike(_MARK)


def pseudonymise(documents: DataFrame, key: str | None = None, back: bool = False) -> DataFrame:
    """The documents with pseudonyms in their texts; ``back`` turns pseudonyms into the values. The key is the
    deployment's secret: given here or in the session's ``spark.relquery.pii.key``; without one nothing is done."""
    key = key or documents.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"a key is needed: pass one or set {KEY_SETTING}")
    at, put = hidden(documents, "found", "new")
    maybe = _maybe(F.col("text"))
    rows = documents.drop("n_pseudonyms").withColumn(at, F.when(maybe, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    rows = rows.withColumn(put, F.when(F.size(at) > 0, F.transform(at, lambda m: pseudonym(m, key, back))))
    gaps = F.split(F.col("text"), PATTERN, -1)
    text = F.when(F.col(put).isNotNull(), F.array_join(F.flatten(F.zip_with(gaps, put, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")).otherwise(F.col("text"))
    count = F.aggregate(F.zip_with(at, put, lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    made = {"text": text, "n_pseudonyms": F.when(F.col(put).isNotNull(), count).otherwise(F.lit(0)).cast("long")}
    if "n_chars" in documents.columns:
        made["n_chars"] = F.when(F.col(put).isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars").cast("long"))
    return rows.withColumns(made).drop(at, put)


def restore(documents: DataFrame, key: str | None = None) -> DataFrame:
    """The documents with their values again, given the key of ``pseudonymise``."""
    return pseudonymise(documents, key, back=True)


def op7_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pseudonymise(documents, spark.conf.get(KEY_SETTING, None) or SHOWN_KEY)
