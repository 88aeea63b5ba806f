"""Format-preserving pseudonyms for personal numbers and dates.

Validated values are permuted within their own format by a keyed Feistel
network: a card number becomes another valid card number, a date another date.
The permutation depends on the key and the value alone, so equal values stay
equal in every document and different values of one format stay different.
Dates have two formats: those that can be read month first (and ISO dates, which
share their permutation), and day-first dates whose day is past 12.
Everything is DataFrame expressions; no row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Formats, as they are looked for.  Fixed values; Java regular expressions.
#: Begins where a run of its letters does, or right behind another value, and gives nothing back: linear in any text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){1,126}+"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,64}(?![0-9A-Za-z])"
IPV4 = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z])(?!\.[0-9])"
DATE = r"(?<![0-9A-Za-z\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/])(?!-[0-9])"
SSN = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])(?!-[0-9])"
LOCAL_PHONE = r"(?<![0-9A-Za-z(])\(?[2-9][0-9]{2}\)?[ .\-][2-9][0-9]{2}[.\-][0-9]{4}(?![0-9A-Za-z])"
#: How the digits of a card are grouped: at once, or in groups with a separator.
GROUPED = r"[0-9]{4}(?:[ \-][0-9]{4}){3}(?:[ \-][0-9]{1,3})?|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}|[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4,5}|[0-9]{4}(?:[ \-][0-9]{3}){3}|[0-9]{6}[ \-][0-9]{13}"
LAYOUT = rf"[0-9]{{12,19}}|{GROUPED}"
#: First digits and lengths that issuers of cards use.
ISSUED = (
    r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}"
    r"|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11}|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|(?:6011|64[4-9][0-9]|65[0-9]{2}|62[0-9]{2})[0-9]{12,15}"
    r"|(?:50(?:18|20|38)|5893|6304|6759|676[1-3])[0-9]{8,15}"
)
WHOLE = r"[0-9](?:[ \-]?[0-9]){11,18}(?![ \-]?[0-9])"
#: Values that stand for themselves behind a space and are no more groups of the number before it.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
NEXT_IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z])(?!\.[0-9])"
_MONTH, _DAY = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
NEXT_DATE = rf"(?:[0-9]{{4}}-{_MONTH}-{_DAY}|(?:{_MONTH}/{_DAY}|{_DAY}/{_MONTH})/[0-9]{{4}})(?![0-9A-Za-z/])(?!-[0-9])"
NEXT = "|".join((EMAIL, NEXT_IPV4, NEXT_DATE, SSN, LOCAL_PHONE))
#: Sixteen digits, written out: look-behind takes no repeated group.
TOO_LONG = r"[0-9][ .\-()]{0,2}" * 15 + "[0-9]"
#: +1 has ten digits more.  Elsewhere groups go on while no other value starts, up to 15 digits.
PHONE = (
    r"(?<![0-9A-Za-z+])\+(?:1[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9A-Za-z])"
    rf"|[0-9]{{1,3}}[ .\-]?\(?[0-9]{{2,4}}\)?(?: (?!{NEXT_IPV4})|[.\-]|)[0-9]{{2,4}}(?: (?!{NEXT})|[.\-]|)[0-9]{{2,4}}"
    rf"(?:(?: (?!{NEXT}|(?:{GROUPED}|{WHOLE})(?![0-9A-Za-z]))|[.\-]|)[0-9]{{2,4}})?(?![0-9A-Za-z])(?<!{TOO_LONG}))"
    rf"|{LOCAL_PHONE}"
)
#: A run of digit groups from 12 digits on: which of them are a card is told by layout and Luhn.
RUN = rf"(?<![0-9A-Za-z])(?=[0-9](?:[ \-]?[0-9]){{11}})[0-9]++(?![A-Za-z])(?:(?: (?!{NEXT})|-)[0-9]++(?![A-Za-z]))*+"
ANY = "|".join((EMAIL, SECRET, PHONE, IPV4, DATE, SSN, RUN))

#: Days from 1800-01-01 to 2199-12-31: one turn of the Gregorian calendar, 189 * 773.
FIRST_DAY, DATE_RADIX = "1800-01-01", (189, 773)
#: Of these the days past the 12th of a month: 9 * 9833.
LATE_RADIX = (9, 9833)


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _mix(key: str, label: Column, round_: Column, half: Column) -> Column:
    """A keyed 60-bit number for one round."""
    said = F.concat_ws("|", F.lit(key), label, round_.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).try_cast("long")


def feistel(key: str, label: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Permute a pair (``left`` < ``left_size``, ``right`` < ``right_size``), returned as struct<l, r>.

    Rounds add a keyed number of one half to the other, modulo its size; the
    halves need not be equal.
    """
    start = F.struct(left.try_cast("long").alias("l"), right.try_cast("long").alias("r"))

    def step(pair: Column, round_: Column) -> Column:
        on_left = round_ % 2 == 0
        return F.struct(
            F.when(on_left, F.pmod(pair["l"] + F.pmod(_mix(key, label, round_, pair["r"]), left_size.try_cast("long")), left_size.try_cast("long"))).otherwise(pair["l"]).alias("l"),
            F.when(on_left, pair["r"]).otherwise(F.pmod(pair["r"] + F.pmod(_mix(key, label, round_, pair["l"]), right_size.try_cast("long")), right_size.try_cast("long"))).alias("r"),
        )

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step)


def permute_digits(key: str, label: str, digits: Column) -> Column:
    """Permute a string of 2 to 36 digits within the strings of its length."""

    def run(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).try_cast("int")
        sizes = F.rpad(F.lit("1"), half + 1, "0").try_cast("long"), F.rpad(F.lit("1"), n - half + 1, "0").try_cast("long")
        pair = feistel(key, F.concat_ws("/", F.lit(label), n.cast("string")), F.substring(d, F.lit(1), half), F.substring(d, half + 1, n - half), *sizes)
        return let(pair, lambda out: F.concat(F.lpad(out["l"].cast("string"), half, "0"), F.lpad(out["r"].cast("string"), n - half, "0")))

    return let(digits, run)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string."""

    def run(d: Column) -> Column:
        n = F.length(d)

        def add(total: Column, place: Column) -> Column:
            digit = F.substring(d, place, F.lit(1)).try_cast("int")
            twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
            return total + F.when((n - place) % 2 == 1, twice).otherwise(digit)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return let(digits, run)


def fill_digits(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, one by one, by those of ``digits``."""

    def run(fresh: Column) -> Column:
        def put(done: Column, place: Column) -> Column:
            char = F.substring(shape, place, F.lit(1))
            is_digit = char.between("0", "9")
            taken = done["used"] + F.when(is_digit, 1).otherwise(0)
            return F.struct(F.concat(done["text"], F.when(is_digit, F.substring(fresh, taken, F.lit(1))).otherwise(char)).alias("text"), taken.alias("used"))

        return F.aggregate(F.sequence(F.lit(1), F.length(shape)), F.struct(F.lit("").alias("text"), F.lit(0).alias("used")), put)["text"]

    return let(digits, run)


def late_rank(day: Column) -> Column:
    """How many days past the 12th of a month lie between ``FIRST_DAY`` and such a day."""
    months = (F.year(day) - 1800) * 12 + F.month(day)
    return F.datediff(day, F.lit(FIRST_DAY).try_cast("date")).try_cast("long") - 12 * months


def late_day(rank: Column) -> Column:
    """The day of a ``late_rank``, as dd/MM/yyyy."""
    # a year has 221 such days or, in leap years, 222
    before = lambda y: F.datediff(F.try_to_date(F.concat((y + 1800).try_cast("string"), F.lit("-01-01"))), F.lit(FIRST_DAY).try_cast("date")) - 144 * y
    lengths = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)

    def of_year(x: Column) -> Column:
        year, rest = x["y"], x["rest"]
        leap = F.when(before(year + 1) - before(year) == 222, 1).otherwise(0)
        starts = F.array(*[F.lit(sum(lengths[:m]) - 12 * m) + (leap if m > 1 else F.lit(0)) for m in range(12)])
        month = F.size(F.filter(starts, lambda s: s <= rest))
        return F.concat_ws("/", F.lpad((rest - F.get(starts, month - 1) + 13).try_cast("string"), 2, "0"), F.lpad(month.try_cast("string"), 2, "0"), (year + 1800).try_cast("string"))

    def of(r: Column) -> Column:
        guess = F.floor(r * 400 / (LATE_RADIX[0] * LATE_RADIX[1])).try_cast("int")
        year = guess + F.when(r >= before(guess + 1), 1).when(r < before(guess), -1).otherwise(0)
        return let(year, lambda y: let(F.struct(y.alias("y"), (r - before(y)).alias("rest")), of_year))

    return let(rank, of)


def _kind(value: Column) -> Column:
    """The format a found value is valid in, "run" for a run of digit groups, or null."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    octets = F.transform(F.split(value, r"\."), lambda x: x.try_cast("int"))
    day = F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "MM/dd/yyyy"), F.try_to_date(value, "dd/MM/yyyy"))
    return (
        F.when(value.contains("@"), "email")
        .when(whole(SECRET) & value.rlike("[a-f]"), "secret")
        .when(whole(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"), F.when(F.year(day).between(1800, 2199), "date"))
        .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.when(~value.rlike(r"^(?:000|666|9)") & ~value.rlike(r"-00-|-0000$"), "ssn"))
        .when(whole(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"), F.when(F.forall(octets, lambda x: x <= 255), "ipv4"))
        .when(value.rlike(r"^[+(]") | whole(r"[2-9][0-9]{2}[ .\-][2-9][0-9]{2}[.\-][0-9]{4}"), F.when(F.length(digits).between(8, 15), "phone"))
        .when(whole(r"[0-9][0-9 \-]+"), "run")
    )


def _cards(run: Column) -> Column:
    """A run of digit groups as array<struct<value, kind>> that joins to the run: cards, and what is between them.

    Cards begin and end with a group, have first digits and a length that
    issuers use, one separator throughout, and pass Luhn.  Spans in a layout of
    cards come first.  Spans in other groups count from the start of the run or
    behind a card, or up to the end of the run.  Where two or more groups that
    no card takes are as wide as groups of a span, the run is a series of
    numbers or a table, and the span is no card.
    """

    def split(parts: Column) -> Column:
        n = F.size(parts)
        joined = lambda first, last: F.array_join(F.slice(parts, first, last - first + 1), "")

        def spans(first: Column) -> Column:
            def of(last: Column) -> Column:
                span = F.regexp_replace(joined(first, last), r"^[ \-]", "")
                digits = F.regexp_replace(span, "[^0-9]", "")
                size = F.length(digits)
                known = span.rlike(f"^(?:{LAYOUT})$")
                # sixteen digits before others, then the longest
                rank = F.when(known & (size == 16), 0).otherwise(20 - size)
                return F.struct(F.when(known, 0).otherwise(1).alias("other"), first.alias("first"), rank.alias("rank"), last.alias("last"), digits.alias("digits"), span.rlike("^(?:[0-9]| (?!.*-)|-(?!.* ))*$").alias("alike"))

            ends = F.transform(F.sequence(first, F.least(first + 18, n)), of)
            good = F.filter(ends, lambda x: x["alike"] & x["digits"].rlike(f"^(?:{ISSUED})$") & (luhn_sum(x["digits"]) % 10 == 0))
            return F.transform(good, lambda x: F.struct(x["other"].alias("other"), x["first"].alias("first"), x["rank"].alias("rank"), x["last"].alias("last")))

        def choose(chosen: Column, x: Column) -> Column:
            free = ~F.exists(chosen, lambda c: (c["first"] <= x["last"]) & (x["first"] <= c["last"]))
            edge = (x["other"] == 0) | (x["first"] == 1) | (x["last"] == n) | F.exists(chosen, lambda c: c["last"] + 1 == x["first"])
            return F.when(free & edge, F.concat(chosen, F.array(F.struct(x["first"].alias("first"), x["last"].alias("last"))))).otherwise(chosen)

        found = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(1), n), spans)))
        chosen = F.array_sort(F.aggregate(found, F.array().cast("array<struct<first:int,last:int>>"), choose))

        def in_no_series(taken: Column) -> Column:
            # widths of the groups that no card takes, as letters between the cards
            letters = F.transform(parts, lambda p: F.substring(F.lit("abcdefghijklmnopqrs"), F.least(F.length(F.regexp_replace(p, "[^0-9]", "")), F.lit(19)), F.lit(1)))
            free = F.array_join(F.filter(F.transform(letters, lambda x, at: F.when(~F.exists(taken, lambda c: (c["first"] <= at + 1) & (at < c["last"])), x)), lambda x: x.isNotNull()), "")
            twice = let(free, lambda text: F.filter(F.split(F.lit("a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s"), ","), lambda w: F.length(text) - F.length(F.replace(text, w, F.lit(""))) > 1))
            own = lambda c: F.slice(letters, c["first"], c["last"] - c["first"] + 1)
            return let(twice, lambda wide: F.filter(taken, lambda c: (c["first"] == c["last"]) | ~F.arrays_overlap(own(c), wide)))

        chosen = let(chosen, lambda taken: F.when(F.size(taken) > 0, in_no_series(taken)).otherwise(taken))
        piece = lambda value, kind: F.struct(value.alias("value"), F.lit(kind).cast("string").alias("kind"))

        def cut(taken: Column) -> Column:
            def one(c: Column, at: Column) -> Column:
                before = F.when(at > 0, F.get(taken, at - 1)["last"]).otherwise(0)
                span = joined(c["first"], c["last"])
                mark = F.regexp_extract(span, r"^[ \-]?", 0)
                return F.array(piece(F.concat(joined(before + 1, c["first"] - 1), mark), None), piece(F.substring(span, F.length(mark) + 1, F.length(span)), "card"))

            done = F.coalesce(F.get(taken, F.size(taken) - 1)["last"], F.lit(0))
            return F.concat(F.flatten(F.transform(taken, one)), F.array(piece(joined(done + 1, n), None)))

        return let(chosen, cut)

    return let(F.regexp_extract_all(run, F.lit(r"[ \-]?[0-9]+"), 0), split)


def _pseudonym(key: str, value: Column, kind: Column) -> Column:
    """The pseudonym of one found value; values without a valid format stay."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    # card: what tells the issuer stays (a leading 4, or four digits), the check digit is made anew
    issuer = F.when(digits.startswith("4"), 1).otherwise(4)
    body = F.concat(F.substring(digits, F.lit(1), issuer), permute_digits(key, "card", F.substring(digits, issuer + 1, n - issuer - 1)))
    check = lambda b: F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10))
    card = let(body, lambda b: fill_digits(value, F.concat(b, check(b).cast("string"))))
    # phone: the country code stays, as far as a separator shows it, and the rest is permuted
    code = F.length(F.regexp_extract(value, r"^\+([0-9]{1,3})(?=[ .\-(])", 1))
    subscriber = F.substring(digits, code + 1, n - code)
    phone = fill_digits(value, F.concat(F.substring(digits, F.lit(1), code), permute_digits(key, "phone", subscriber)))
    # IPv4: 32 bits, as two halves of 16
    octet = F.transform(F.split(value, r"\."), lambda x: x.try_cast("long"))
    bits = feistel(key, F.lit("ipv4"), octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536))
    ipv4 = let(bits, lambda x: F.concat_ws(".", F.floor(x["l"] / 256).cast("string"), (x["l"] % 256).cast("string"), F.floor(x["r"] / 256).cast("string"), (x["r"] % 256).cast("string")))
    # SSN: area 001-899 without 666 (898), group 01-99, serial 0001-9999
    area, group, serial = (F.substring(value, F.lit(a), F.lit(b)).try_cast("long") for a, b in ((1, 3), (5, 2), (8, 4)))
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    ssn_pair = feistel(key, F.lit("ssn"), rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def ssn_of(x: Column) -> Column:
        new_area = F.floor(x["l"] / 99) + 1
        new_area += F.when(new_area >= 666, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((x["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0"))

    ssn = let(ssn_pair, ssn_of)
    # dates: the day's number in 400 years; day-first dates, whose day is past 12, are counted by themselves
    iso = value.rlike("^[0-9]{4}-")
    month_first = F.try_to_date(value, "MM/dd/yyyy")
    day = F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), month_first, F.try_to_date(value, "dd/MM/yyyy"))
    number = lambda d: F.datediff(d, F.lit(FIRST_DAY).try_cast("date")).try_cast("long")
    move = lambda label, n, a, b: let(feistel(key, F.lit(label), F.floor(n / b), n % b, F.lit(a), F.lit(b)), lambda x: x["l"] * b + x["r"])
    new_day = F.date_add(F.lit(FIRST_DAY).try_cast("date"), move("date", number(day), *DATE_RADIX).try_cast("int"))
    date = (
        F.when(iso, F.date_format(new_day, "yyyy-MM-dd"))
        .when(month_first.isNotNull(), F.date_format(new_day, "MM/dd/yyyy"))
        .otherwise(late_day(move("late day", late_rank(day), *LATE_RADIX)))
    )
    # mail addresses and secrets have no counted domain: a keyed name of 60 bits, a keyed string of the same length
    local = F.substring_index(value, "@", 1)
    letters = F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 15), "0123456789", "ghijklmnop")
    email = F.concat(letters, F.substring(value, F.length(local) + 1, F.length(value)))
    secret = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256), F.lit(1), F.length(value))
    return (
        F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "ipv4", ipv4).when(kind == "ssn", ssn)
        .when(kind == "date", date).when(kind == "email", email).when(kind == "secret", secret).otherwise(value)
    )


KINDS = ("card", "phone", "ipv4", "ssn", "date", "email", "secret")


def pseudonymise(documents: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """Replace personal values in column ``text``; with ``counts`` add ``n_<kind>`` (int) and ``n_private``.

    Other columns stay as they are (columns of those names are replaced).  A
    null text stays null and counts nothing; an empty text stays empty.  Found
    values that fail their format's check (Luhn, octets, calendar) stay.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    found = F.when(source.rlike("[0-9@]"), F.regexp_extract_all(source, F.lit(f"({ANY})"), 1)).otherwise(F.array().cast("array<string>"))
    out = documents.withColumn("__found", found)
    parts = lambda x: F.when(x["kind"] == "run", _cards(x["value"])).otherwise(F.array(x))
    out = out.withColumn("__found", F.transform("__found", lambda v: let(F.struct(v.alias("value"), _kind(v).alias("kind")), parts)))
    rest = F.split(F.col(text), ANY, -1)
    renewed = lambda found: F.array_join(F.transform(found, lambda x: _pseudonym(key, x["value"], x["kind"])), "")
    fresh = F.concat(F.transform("__found", renewed), F.array(F.lit("")))
    private = F.filter(F.flatten("__found"), lambda x: x["kind"].isNotNull())
    new_text = F.when(F.size(private) > 0, F.array_join(F.zip_with(rest, fresh, lambda a, b: F.concat(a, b)), "")).otherwise(F.col(text))
    out = out.withColumn("__new", new_text)
    if counts:
        of = lambda k: F.size(F.filter(private, lambda x: x["kind"] == k)).try_cast("int")
        out = out.withColumns({f"n_{k}": of(k) for k in KINDS} | {"n_private": F.size(private).try_cast("int")})
    return out.withColumn(text, F.col("__new")).drop("__found", "__new")
