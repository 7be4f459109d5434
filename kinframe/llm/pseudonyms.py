"""Format-preserving pseudonyms for numbers and dates, in SQL expressions only.

Candidates are found by one pattern, validated, and permuted inside their own format by a
keyed Feistel network: payment cards (issuer range and Luhn check digit), account numbers
(IBAN), telephone numbers, IPv4 addresses, social security numbers, calendar dates, and the
local parts of mail addresses. The permutation depends on the key, the kind and the sizes of
the format only, so equal values get equal pseudonyms in every document and stay linked;
separators stay in place. A pseudonym passes the validation that its value passed, and no
value has to be tried again, because every domain is a product of two sizes:

- A card keeps the digits that name its issuer range and gets a matching check digit.
- An IBAN keeps its country and letters, has its other digits permuted, and gets matching
  check digits. Check digits that a country hides further back are not renewed.
- A ten-digit number of the American plan keeps valid area and exchange codes (from 200)
  valid, and invalid ones invalid. One with another country code keeps that code and the
  next digit; a French one without country code keeps its first two digits.
- A social security number is one of 898 areas, 99 groups and 9,999 serials.
- A date is one of the 146,097 days of 1800 to 2199, which is 189 * 773.

What fails validation (16 digits without a valid check digit, a day that does not exist) is
left as it is. The key is the caller's own; there is none in this module.

The network has ``ROUNDS`` rounds over two halves; a round adds a number drawn from SHA-256
of key, kind, sizes, round and the other half, modulo the size of the half. Everything is
an expression over one row: no join and no shuffle.

Rows: a null text stays null and an empty one empty. Rows that repeat get the same result.
Other columns pass through, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# The 400-year cycle of the calendar, and its days as a product.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
# Areas, groups and serials of social security numbers; area 666 is none.
AREAS, GROUPS, SERIALS, NO_AREA = 898, 99, 9999, 666
# Prefixes of card issuers that have one or two digits; others have four.
ONE_DIGIT, TWO_DIGITS = "^4", "^(5[1-5]|3[4678]|65)"
# Country codes of telephone numbers with one or two digits; others have three.
SHORT_CODES, LONG_CODES = "^7", "^(20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK|FI|FO|GL|NL",
    19: "MK|SI",
    20: "AT|BA|EE|KZ|LT|LU|XK",
    21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "PT",
    26: "IS|TR",
    27: "FR|GR|IT|MC|SM",
    28: "AL|AZ|CY|DO|GT|HU|LB|PL",
    29: "BR|PS|QA|UA",
    30: "JO|KW|MU",
    31: "MT|SC",
}

# Every repetition is bounded, so a very long word costs no more than its length.
MAIL = r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]{0,250}\.[A-Za-z]{2,24}\b"
PHONE = r"(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}\b|(?:\+1[ .-]?|\b)[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b"
WORLD = r"\+[2-9][0-9]{1,2}(?: ?\(0\))?(?:[ .-]?[0-9]){6,13}\b"
FRENCH = r"0[1-9](?:[ .][0-9]{2}){4}"
IBAN = "(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")"
ISO_DATE, DAY_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}[./][0-9]{2}[./][0-9]{4}"
ADDRESS = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
SOCIAL = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
CANDIDATE = MAIL + "|" + PHONE + "|" + WORLD + r"|\b(?:" + "|".join([IBAN, FRENCH, ISO_DATE, DAY_DATE, ADDRESS, SOCIAL, CARD]) + r")\b"
MAY_HOLD = "[0-9]{2}|@|[0-9][.]"


class Spark:
    """How the expressions are spelled in Spark SQL."""

    @staticmethod
    def pattern(p: str) -> str:
        return 'r"' + p + '"'

    like = "({} RLIKE {})"
    replace_all = "regexp_replace({}, {}, '{}')"
    hash_number = "CAST(conv(substring(sha2({}, 256), 1, 12), 16, 10) AS BIGINT)"
    letters_to_number = "CAST(conv({}, 36, 10) AS BIGINT)"
    number_to_letters = "lower(conv({}, 10, 36))"
    positions = "sequence(1, {})"
    rounds = f"sequence(0, {ROUNDS - 1})"
    each = "transform({}, {} -> {})"
    join = "array_join({}, '')"
    split = "split({}, {})"
    extract = "regexp_extract_all({}, {}, 0)"
    date = "CAST(try_to_date({}, '{}') AS DATE)"
    date_formats = {"ymd": "yyyy-MM-dd", "dmy": "ddMMyyyy", "mdy": "MMddyyyy"}
    days_since = "datediff({}, DATE'{}')"
    add_days = "date_add(DATE'{1}', CAST({0} AS INT))"
    date_text = "date_format({}, '{}')"
    fold = "aggregate({}, {}, (s, r) -> {})"
    state = "named_struct('a', {}, 'b', {}, 'ma', {}, 'mb', {})"
    total = "aggregate({}, CAST(0 AS BIGINT), (t, x) -> t + x)"
    power = "CAST(pow({}, {}) AS BIGINT)"
    divide = "({} DIV {})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Expressions:
    """The pseudonym of one candidate, as SQL text over a column or variable name."""

    def __init__(self, dialect, key: str):
        self.d, self.key = dialect, key

    def feistel(self, a: str, b: str, ma: str, mb: str, tag: str) -> str:
        """A struct whose ``a`` and ``b`` are the permuted halves."""
        d = self.d
        seed = f"concat({_quoted(self.key + '|' + tag + '|')}, CAST(s.ma AS STRING), '|', CAST(s.mb AS STRING), '|', CAST(r AS STRING), '|', CAST(s.b AS STRING))"
        step = d.state.format("s.b", f"(s.a + {d.hash_number.format(seed)}) % s.ma", "s.mb", "s.ma")
        start = d.state.format(*(f"CAST({x} AS BIGINT)" for x in (a, b, ma, mb)))
        return d.fold.format(d.rounds, start, step)

    def number(self, digits: str, tag: str) -> str:
        """A string of digits permuted among the strings of its length."""
        d = self.d
        half = d.divide.format(f"length({digits})", 2)
        rest = f"length({digits}) - {half}"
        a = f"CAST(concat('0', substring({digits}, 1, CAST({half} AS INT))) AS BIGINT)"
        b = f"CAST(substring({digits}, CAST({half} + 1 AS INT)) AS BIGINT)"
        out = self.feistel(a, b, d.power.format(10, half), d.power.format(10, rest), tag)
        return self._let(out, lambda s: f"concat(CASE WHEN {half} > 0 THEN lpad(CAST({s}.a AS STRING), CAST({half} AS INT), '0') ELSE '' END, lpad(CAST({s}.b AS STRING), CAST({rest} AS INT), '0'))")

    def letters(self, x: str, tag: str) -> str:
        """At most 20 lower letters and digits permuted among the strings of their length."""
        d = self.d
        half = d.divide.format(f"length({x})", 2)
        rest = f"length({x}) - {half}"
        a = d.letters_to_number.format(f"concat('0', substring({x}, 1, CAST({half} AS INT)))")
        b = d.letters_to_number.format(f"substring({x}, CAST({half} + 1 AS INT))")
        out = self.feistel(a, b, d.power.format(36, half), d.power.format(36, rest), tag)
        text = lambda v, n: f"CASE WHEN {n} > 0 THEN lpad({d.number_to_letters.format(v)}, CAST({n} AS INT), '0') ELSE '' END"
        return self._let(out, lambda s: f"concat({text(f'{s}.a', half)}, {text(f'{s}.b', rest)})")

    def _let(self, value: str, body) -> str:
        """``body`` over a name for ``value``, which is computed once."""
        self.names = getattr(self, "names", 0) + 1
        name = f"v{self.names}"
        return f"element_at({self.d.each.format(f'array({value})', name, body(name))}, 1)"

    def digits(self, m: str) -> str:
        return self.d.replace_all.format(m, self.d.pattern("[^0-9]"), "")

    def placed(self, m: str, new: str, kind: str) -> str:
        """``m`` with its characters of class ``kind`` replaced by those of ``new``, in order."""
        d = self.d
        char = f"substring({m}, i, 1)"
        at = f"length({d.replace_all.format(f'substring({m}, 1, i)', d.pattern(f'[^{kind}]'), '')})"
        taken = f"substring(n, {at}, 1)"
        body = f"CASE WHEN NOT {d.like.format(char, d.pattern(f'[{kind}]'))} THEN {char} WHEN {d.like.format(char, d.pattern('[A-Z]'))} THEN upper({taken}) ELSE {taken} END"
        inner = d.join.format(d.each.format(d.positions.format(f"length({m})"), "i", body))
        return f"element_at({d.each.format(f'array({new})', 'n', inner)}, 1)"

    def luhn(self, digits: str, shift: int) -> str:
        """The check sum; every second digit from the right counts double, from ``shift``."""
        d = self.d
        x = f"CAST(substring({digits}, i, 1) AS BIGINT)"
        twice = f"(CASE WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END)"
        body = f"CASE WHEN (length({digits}) - i) % 2 = {shift} THEN {twice} ELSE {x} END"
        return d.total.format(d.each.format(d.positions.format(f"length({digits})"), "i", body))

    def card(self, m: str) -> str:
        def body(x):
            valid = f"{self.d.like.format(x, self.d.pattern('^(3|4|5[1-5]|6|2[2-7])'))} AND {self.luhn(x, 1)} % 10 = 0"
            issuer = f"CASE WHEN {self.d.like.format(x, self.d.pattern(ONE_DIGIT))} THEN 1 WHEN {self.d.like.format(x, self.d.pattern(TWO_DIGITS))} THEN 2 ELSE 4 END"
            own = lambda k: self._let(f"substring({x}, {k} + 1, length({x}) - {k} - 1)", lambda y: self.number(y, "card"))
            inner = self._let(issuer, lambda k: f"concat(substring({x}, 1, {k}), {own(k)})")
            whole = self._let(inner, lambda y: f"concat({y}, CAST((10 - {self.luhn(y, 0)} % 10) % 10 AS STRING))")
            return f"CASE WHEN {valid} THEN {self.placed(m, whole, '0-9')} ELSE {m} END"

        return self._let(self.digits(m), body)

    def remainder(self, x: str) -> str:
        """Digits and capital letters, which count from 10, as a number modulo 97."""
        char = f"substring({x}, r, 1)"
        digit = self.d.like.format(char, self.d.pattern("[0-9]"))
        step = f"CASE WHEN {digit} THEN (s * 10 + CAST({char} AS BIGINT)) % 97 ELSE (s * 100 + CAST(ascii({char}) AS BIGINT) - 55) % 97 END"
        return self.d.fold.format(self.d.positions.format(f"length({x})"), "CAST(0 AS BIGINT)", step)

    def chunks(self, x: str, size: int, permuted) -> str:
        """``x`` permuted ``size`` characters at a time."""
        d = self.d
        count = f"CAST({d.divide.format(f'(length({x}) + {size - 1})', size)} AS INT)"
        return d.join.format(d.each.format(d.positions.format(count), "k", self._let(f"substring({x}, k * {size} - {size - 1}, {size})", permuted)))

    def iban(self, m: str) -> str:
        d = self.d

        def body(x):
            valid = f"{self._let(f'concat(substring({x}, 5), substring({x}, 1, 4))', self.remainder)} = 1"
            digits = self._let(self.digits(f"substring({x}, 5)"), lambda y: self.chunks(y, 18, lambda c: self.number(c, "iban")))
            account = self.placed(f"substring({x}, 5)", digits, "0-9")
            check = lambda y: self._let(f"concat({y}, substring({x}, 1, 2), '00')", lambda z: f"lpad(CAST(98 - {self.remainder(z)} AS STRING), 2, '0')")
            whole = self._let(account, lambda y: f"concat(substring({x}, 1, 2), {check(y)}, {y})")
            # A digit stands for each digit and a letter for each letter.
            return f"CASE WHEN {valid} AND {d.like.format(f'substring({x}, 5)', d.pattern('[0-9]'))} THEN {self.placed(m, whole, 'A-Z0-9')} ELSE {m} END"

        return self._let(d.replace_all.format(m, d.pattern(" "), ""), body)

    def phone(self, m: str) -> str:
        """A country code ``+1`` stays; area and exchange codes stay on their side of 200."""
        head = f"CASE WHEN {self.d.like.format(m, self.d.pattern('^[+]1'))} THEN '1' ELSE '' END"

        def body(x):
            area, exchange, line = (f"CAST(substring({x}, {i}, {n}) AS BIGINT)" for i, n in ((1, 3), (4, 3), (7, 4)))
            least = lambda c: f"(CASE WHEN {c} < 200 THEN 0 ELSE 200 END)"
            codes = lambda c: f"(CASE WHEN {c} < 200 THEN 200 ELSE 800 END)"
            out = self.feistel(f"{area} - {least(area)}", f"({exchange} - {least(exchange)}) * 10000 + {line}", codes(area), f"{codes(exchange)} * 10000", "phone")
            parts = lambda s: ((f"{s}.a + {least(area)}", 3), (f"{self.d.divide.format(f'{s}.b', 10000)} + {least(exchange)}", 3), (f"{s}.b % 10000", 4))
            return self._let(out, lambda s: f"concat({head}, " + ", ".join(f"lpad(CAST({v} AS STRING), {n}, '0')" for v, n in parts(s)) + ")")

        return self.placed(m, self._let(self.digits(m), lambda x: self._let(f"substring({x}, length({x}) - 9)", body)), "0-9")

    def behind(self, m: str, kept: str, tag: str) -> str:
        """All digits of ``m`` but the first ``kept``, an expression over ``x``, permuted."""
        own = lambda x, k: self._let(f"substring({x}, {k} + 1)", lambda y: self.number(y, tag))
        return self._let(self.digits(m), lambda x: self.placed(m, self._let(kept.replace("{x}", x), lambda k: f"concat(substring({x}, 1, {k}), {own(x, k)})"), "0-9"))

    def world(self, m: str) -> str:
        """Country code, a trunk ``(0)`` and the next digit stay."""
        d = self.d
        code = f"CASE WHEN {d.like.format('{x}', d.pattern(SHORT_CODES))} THEN 1 WHEN {d.like.format('{x}', d.pattern(LONG_CODES))} THEN 2 ELSE 3 END"
        return self.behind(m, f"1 + {code} + CASE WHEN {m} LIKE '%(0)%' THEN 1 ELSE 0 END", "world")

    def social(self, m: str) -> str:
        d = self.d
        bad = d.like.format(m, d.pattern("^(000|666|9..)|-00-|0000$"))
        area, group, serial = (f"CAST(substring({m}, {i}, {n}) AS BIGINT)" for i, n in ((1, 3), (5, 2), (8, 4)))
        a = f"{area} - CASE WHEN {area} > {NO_AREA} THEN 2 ELSE 1 END"
        out = self.feistel(a, f"({group} - 1) * {SERIALS} + {serial} - 1", str(AREAS), str(GROUPS * SERIALS), "social")
        parts = lambda s: ((f"{s}.a + CASE WHEN {s}.a + 1 < {NO_AREA} THEN 1 ELSE 2 END", 3), (f"{d.divide.format(f'{s}.b', SERIALS)} + 1", 2), (f"{s}.b % {SERIALS} + 1", 4))
        new = self._let(out, lambda s: "concat_ws('-', " + ", ".join(f"lpad(CAST({v} AS STRING), {n}, '0')" for v, n in parts(s)) + ")")
        return f"CASE WHEN {bad} THEN {m} ELSE {new} END"

    def address(self, m: str) -> str:
        d = self.d
        part = [f"CAST(element_at(p, {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
        valid = " AND ".join(f"{x} <= 255" for x in part)
        new = self._let(
            self.feistel(f"{part[0]} * 256 + {part[1]}", f"{part[2]} * 256 + {part[3]}", "65536", "65536", "address"),
            lambda s: "concat(" + ", '.', ".join(f"CAST({x} AS STRING)" for x in (d.divide.format(f"{s}.a", 256), f"{s}.a % 256", d.divide.format(f"{s}.b", 256), f"{s}.b % 256")) + ")",
        )
        parts = d.split.format(m, d.pattern("[.]"))
        return f"element_at({d.each.format(f'array({parts})', 'p', f'CASE WHEN {valid} THEN {new} ELSE {m} END')}, 1)"

    def day(self, m: str, form: str) -> str:
        """A date, kept as it is if the day does not exist or lies outside the cycle."""
        d = self.d
        source = m if form == "ymd" else self.digits(m)

        def permuted(n):
            out = self.feistel(d.divide.format(n, DAYS[1]), f"{n} % {DAYS[1]}", str(DAYS[0]), str(DAYS[1]), "date")
            new = self._let(out, lambda s: d.date_text.format(d.add_days.format(f"({s}.a * {DAYS[1]} + {s}.b)", FIRST_DAY), d.date_formats[form]))
            return f"CASE WHEN {n} BETWEEN 0 AND {DAYS[0] * DAYS[1] - 1} THEN {new if form == 'ymd' else self.placed(m, new, '0-9')} ELSE {m} END"

        return self._let(f"CAST({d.days_since.format(d.date.format(source, d.date_formats[form]), FIRST_DAY)} AS BIGINT)", permuted)

    def mail(self, m: str) -> str:
        """The local part's letters and digits, 20 at a time; the domain stays."""
        d = self.d
        local = f"element_at({d.split.format(m, d.pattern('@'))}, 1)"

        def body(x):
            plain = f"lower({d.replace_all.format(x, d.pattern('[^A-Za-z0-9]'), '')})"
            permuted = self._let(plain, lambda y: self.chunks(y, 20, lambda c: self.letters(c, "mail")))
            return f"concat({self.placed(x, permuted, 'A-Za-z0-9')}, substring({m}, length({x}) + 1))"

        return self._let(local, body)

    def kind(self, m: str) -> str:
        whole = lambda p: self.d.like.format(m, self.d.pattern(f"^(?:{p})$"))
        month_first = f"{self.d.date.format(self.digits(m), self.d.date_formats['dmy'])} IS NULL"
        return (
            f"CASE WHEN {m} LIKE '%@%' THEN 'mail' WHEN {whole(PHONE)} THEN 'phone' WHEN {m} LIKE '+%' THEN 'world' "
            f"WHEN {m} RLIKE '^[A-Z]' THEN 'iban' WHEN {whole(FRENCH)} THEN 'french' WHEN {whole(ISO_DATE)} THEN 'ymd' "
            f"WHEN {whole(DAY_DATE)} THEN CASE WHEN {month_first} THEN 'mdy' ELSE 'dmy' END WHEN {whole(ADDRESS)} THEN 'address' WHEN {whole(SOCIAL)} THEN 'social' ELSE 'card' END"
        )

    def pseudonym(self, m: str) -> str:
        days = " ".join(f"WHEN '{f}' THEN {self.day(m, f)}" for f in ("ymd", "dmy", "mdy"))
        return (
            f"CASE {self.kind(m)} WHEN 'mail' THEN {self.mail(m)} WHEN 'phone' THEN {self.phone(m)} WHEN 'world' THEN {self.world(m)} WHEN 'iban' THEN {self.iban(m)} WHEN 'french' THEN {self.behind(m, '2', 'french')} {days} "
            f"WHEN 'address' THEN {self.address(m)} WHEN 'social' THEN {self.social(m)} ELSE {self.card(m)} END"
        )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with the numbers, dates and mail names of ``text_col`` replaced.

    ``counts`` may name two columns to add: how many candidates there were, and how many
    of them were replaced.
    """
    d, e = Spark, Expressions(Spark, key)
    text = f"`{text_col}`"
    # Columns of our own lie under a prefix that no column of the caller's has.
    own = "__"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    old, new, whole = (f"{own}{c}" for c in ("old", "new", "text"))
    some = d.like.format(text, d.pattern(MAY_HOLD))
    out = docs.withColumn(old, F.expr(f"CASE WHEN {some} THEN {d.extract.format(text, d.pattern(CANDIDATE))} ELSE CAST(array() AS ARRAY<STRING>) END"))
    out = out.withColumn(new, F.expr(d.each.format(old, "m", f"coalesce({e.pseudonym('m')}, m)")))
    pieces = f"zip_with({d.split.format(text, d.pattern(CANDIDATE))}, {new}, (p, n) -> concat(p, coalesce(n, '')))"
    out = out.withColumn(whole, F.expr(f"CASE WHEN size({old}) > 0 THEN {d.join.format(pieces)} ELSE {text} END"))
    added = []
    if counts:
        found, replaced = counts
        added = [F.size(old).cast("long").alias(found), F.expr(f"CAST(size(filter(zip_with({old}, {new}, (o, n) -> o <> n), x -> x)) AS BIGINT)").alias(replaced)]
    kept = [F.col(whole).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*kept, *added)
