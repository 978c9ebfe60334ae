"""Format-preserving pseudonyms for personal numbers and dates. DataFrame functions only.

A value that is found by its form and passes its validity rule is permuted within its format by a keyed Feistel network:
halves of its digits are added to a keyed hash of each other for `ROUNDS` rounds; a result that breaks the rule is
permuted again until it keeps it (cycle walking). A permutation maps equal values to equal pseudonyms in every document
and different ones to different ones; separators stay where they were. Check digits are computed anew.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The key of the permutations; deployments pass their own.
KEY = "public demonstration key"
ROUNDS = 8
#: Cycle walks; each ends with a probability of a third or more, so one in 10^18 would not end.
WALKS = 96
#: Days from 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS = "1900-01-01", 73049

#: Lengths of IBANs and the countries that have them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
#: Country codes of phone numbers.
COUNTRY_CODE = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _iban_form() -> str:
    """The length of the country first, so that a word behind the number is not taken; then any length."""
    rest = lambda n: f"(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    own = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}{rest(n)}" for n, names in IBAN_LENGTHS.items())
    return rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{own})\b|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b)"


SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
DATE = (r"(?=[0-9])(?<![\w./-])(?:" + "|".join(f"[0-9]{{4}}{c}[0-9]{{1,2}}{c}[0-9]{{1,2}}|[0-9]{{1,2}}{c}[0-9]{{1,2}}{c}[0-9]{{4}}" for c in ("-", "/", r"\."))
        + r")(?:(?=T[0-9]{2})|(?![\w/-]))")
IP = r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])"
#: North American with brackets, with +1, and in groups of 3, 3 and 4; other countries' with + and 7 to 15 digits.
BARE_PHONE = r"(?<![\w+./-])(?:1[ .-])?(?:" + "|".join(f"[0-9]{{3}}{c}[0-9]{{3}}{c}[0-9]{{4}}" for c in ("-", " ", r"\.")) + r")(?!\w|-[0-9])"
PHONE = (r"(?=[+(0-9])(?:(?<![\w+])(?:\+?1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![\w+])\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|" + BARE_PHONE
         + rf"|(?<![\w+])\+[1-9](?:(?! (?:{SSN}|{DATE}|{IP}))[ ./-]?\(?[0-9]\)?){{6,14}}(?![0-9]))")
#: From the start of a run of its characters (marks before the name stay as they are), so that a run without @ is read once;
#: possessive, so that Java loops over the domain instead of recursing.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))(?=[._%+-]*+[A-Za-z0-9])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: Kind, pattern. The first that matches at a place wins.
FORMS = {
    "email": EMAIL,
    "secret": r"(?i:password|passwd|token|secret|api_?key)[ \t]*[=:][ \t]*[\"']?[A-Za-z0-9_-]{8,}|\bAKIA[A-Z0-9]{16}\b",
    "iban": _iban_form(),
    "phone": PHONE,
    "ssn": SSN,
    "date": DATE,
    "ip": IP,
    "card": rf"(?<![\w-])(?=(?:[ -]?[0-9]){{13}})[0-9]++(?!\w)(?:[ -](?!{BARE_PHONE}|{SSN}|{DATE}|{IP})[0-9]++(?!\w))*+",
}
KINDS = tuple(FORMS)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash(key: str, kind: str, i: Column, number: Column, modulus: Column | int) -> Column:
    """Keyed round function: 60 bits of SHA-256, modulo the size of the half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), number.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(modulus) if isinstance(modulus, int) else modulus)


def feistel(left: Column, right: Column, size_left: Column | int, size_right: Column | int, key: str, kind: str) -> Column:
    """The pair (a, b) permuted in [0, size_left) x [0, size_right)."""
    size_left, size_right = (F.lit(s).cast("bigint") if isinstance(s, int) else s.cast("bigint") for s in (size_left, size_right))

    def round_(acc: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, size_left).otherwise(size_right)
        # Added modulo the size without leaving 63 bits.
        room = size - _hash(key, kind, i, acc["b"], size)
        return F.struct(acc["b"].alias("a"), F.when(acc["a"] >= room, acc["a"] - room).otherwise(acc["a"] - room + size).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b")), round_)


def permute_digits(text: Column, radix: int, key: str, kind: str) -> Column:
    """A string of digits in `radix` (0-9, then a-z) permuted among those of its length, up to 24 digits."""
    low = F.floor(F.length(text) / 2).cast("int")
    high = F.length(text) - low
    number = lambda part: F.conv(part, radix, 10).cast("bigint")
    size = lambda n: F.element_at(F.array(*[F.lit(radix ** k) for k in range(13 if radix > 10 else 18)]), n + 1)
    done = feistel(number(F.concat(F.lit("0"), F.substr(text, F.lit(1), low))), number(F.substr(text, low + 1, high)), size(low), size(high), key, kind)
    back = lambda x, n: F.call_function("lpad", F.lower(F.conv(x.cast("string"), 10, radix)), n, F.lit("0"))
    return _let(done, lambda p: F.concat(F.when(low > 0, back(p["a"], low)).otherwise(F.lit("")), back(p["b"], high)))


def walk(start: Column, step, valid) -> Column:
    """step(start), stepped on until valid."""
    state = F.struct(step(start).alias("v"), F.lit(False).alias("end"))
    go = lambda acc: F.when(acc["end"] | valid(acc["v"]), F.struct(acc["v"].alias("v"), F.lit(True).alias("end"))).otherwise(
        F.struct(step(acc["v"]).alias("v"), F.lit(False).alias("end")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), state, lambda acc, _: go(acc))["v"]


def luhn(digits: Column) -> Column:
    """Sum of a digit string in the card check; 0 modulo 10 for a valid number."""
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + _let(
        F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0)))))


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN (no spaces) in its check; 1 for a valid one."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    add = lambda acc, code: F.when(code < 65, acc * 10 + (code - 48)).otherwise(acc * 100 + (code - 55)) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), lambda acc, i: add(acc, F.ascii(F.substr(moved, i, F.lit(1)))))


def refill(shape: Column, chars: Column, drawn: str) -> Column:
    """`shape` with its characters of class `drawn` replaced, in order, by those of `chars`."""
    return F.array_join(F.zip_with(F.split(shape, f"[{drawn}]", -1), F.split(chars, ""), lambda p, c: F.when(
        p.isNotNull(), F.concat(p, F.coalesce(c, F.lit("")))).otherwise(F.lit(""))), "")


def only(text: Column, drawn: str) -> Column:
    return F.regexp_replace(text, f"[^{drawn}]", "")


def _card(m: Column, key: str) -> Column:
    """text, n: a run of digit groups with the cards in it replaced, and how many they are.

    A card is 13 to 19 digits from the start of the run to the end of a group or, further in, in the groups that cards
    are printed in. Where several overlap, the forms in use go first, then the first and longest.
    """
    def new(d: Column) -> Column:
        # The first digit stays, the check digit is computed.
        drawn = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), 10, key, "card"))
        return _let(drawn, lambda b: F.concat(b, F.pmod(F.lit(10) - luhn(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    rank = lambda d: F.when(d.rlike("^(?:4.{15}|5[1-5].{14}|2[2-7].{14}|6.{15}|3[47].{13}|3[0689].{12})$"), 0).when(F.length(d) == 16, 1).otherwise(2)

    def spans(g: Column) -> Column:
        printed = lambda t: t.rlike("^(?:[0-9]+|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})[ -]?$")
        one = lambda i, j: _let(F.array_join(F.slice(g, i, j - i + 1), ""), lambda t: _let(only(t, "0-9"), lambda d: F.when(
            F.length(d).between(13, 19) & ((i == 1) | printed(t)) & (luhn(d) % 10 == 0), F.struct(rank(d).alias("rank"), i.alias("i"), (-j).alias("j")))))
        each = F.flatten(F.transform(F.sequence(F.lit(1), F.size(g)), lambda i: F.transform(F.sequence(i, F.least(F.size(g), i + 18)), lambda j: one(i, j))))
        return F.array_sort(F.filter(each, lambda s: s.isNotNull()))

    def put(g: Column, taken: Column) -> Column:
        def at(x: Column) -> Column:
            own = F.filter(taken, lambda s: (s["i"] <= x) & (x <= -s["j"]))
            return _let(own, lambda o: F.when(F.size(o) == 0, F.element_at(g, x)).when(o[0]["i"] < x, F.lit("")).otherwise(
                _let(F.array_join(F.slice(g, x, -o[0]["j"] - x + 1), ""), lambda t: refill(t, new(only(t, "0-9")), "0-9"))))
        return F.struct(F.array_join(F.transform(F.sequence(F.lit(1), F.size(g)), at), "").alias("text"), F.size(taken).alias("n"))

    def chosen(s: Column) -> Column:
        free = lambda acc, x: ~F.exists(acc, lambda t: (t["i"] <= -x["j"]) & (x["i"] <= -t["j"]))
        return F.aggregate(s, F.array().cast("array<struct<rank:int,i:int,j:int>>"), lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))

    return _let(F.regexp_extract_all(m, F.lit("([0-9]+[ -]?)"), 1), lambda g: _let(chosen(spans(g)), lambda t: put(g, t)))


def _phone(m: Column, key: str) -> Column:
    """Numbers of the North American plan stay in it, and others of its form outside it; country codes stay."""
    def plan(d: Column) -> Column:
        last = F.substr(d, F.length(d) - 9)
        valid = lambda b: b.rlike("^[2-9]..[2-9]")
        drawn = _let(last, lambda x: walk(x, lambda b: permute_digits(b, 10, key, "phone"), lambda b: valid(b) == valid(x)))
        return F.concat(F.substr(d, F.lit(1), F.length(d) - 10), drawn)

    def abroad(d: Column) -> Column:
        return _let(F.regexp_extract(d, COUNTRY_CODE, 0), lambda c: F.concat(c, permute_digits(F.substr(d, F.length(c) + 1), 10, key, "phone abroad")))
    return _let(only(m, "0-9"), lambda d: refill(m, _let(F.when(m.startswith("+") & ~d.rlike("^1.{10}$"), abroad(d)).otherwise(plan(d)), lambda x: x), "0-9"))


def _ssn(m: Column, key: str) -> Column:
    valid = lambda d: d.rlike("^(?!000|666|9)...(?!00)..(?!0000)....$")
    return _let(only(m, "0-9"), lambda d: F.when(valid(d), refill(m, walk(d, lambda b: permute_digits(b, 10, key, "ssn"), valid), "0-9")).otherwise(m))


def _ip(m: Column, key: str) -> Column:
    def new(o: Column) -> Column:
        part = lambda k: F.element_at(o, k).cast("int")
        pair = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), 65536, 65536, key, "ip")
        return _let(pair, lambda p: F.concat_ws(".", *[F.floor(p[h] / d).cast("int") % 256 for h in "ab" for d in (256, 1)]))
    octets = F.split(m, "\\.")
    return F.when(F.exists(octets, lambda x: x.cast("int") > 255), m).otherwise(_let(octets, new))


def _date(m: Column, key: str) -> Column:
    """Years stand first or last. Where one of day and month has one digit, the new date is written without leading zeros."""
    first = F.lit(FIRST_DAY).cast("date")
    plain = F.translate(m, "./", "--")
    number = lambda form: F.datediff(F.try_to_timestamp(plain, F.lit(form)).cast("date"), first)
    as_ = lambda form: F.when(number(form).between(0, DAYS - 1), F.struct(F.lit(form).alias("form"), number(form).cast("bigint").alias("day")))
    read = (F.when(m.rlike("^[0-9]{4}"), as_("y-M-d")).when(m.contains("/"), F.coalesce(as_("M-d-y"), as_("d-M-y"))).when(m.contains("-"), F.coalesce(as_("d-M-y"), as_("M-d-y")))
            .otherwise(as_("d-M-y")))
    step = lambda v: _let(feistel(F.floor(v / 512).cast("bigint"), v % 512, 256, 512, key, "date"), lambda p: p["a"] * 512 + p["b"])

    def written(form: Column, day: Column) -> Column:
        short = m.rlike("(?<![0-9])[0-9](?![0-9])")
        out = F
        for f in ("y-M-d", "M-d-y", "d-M-y"):
            full = f.replace("y", "yyyy")
            out = out.when((form == f) & short, F.date_format(day, full)).when(form == f, F.date_format(day, full.replace("M", "MM").replace("d", "dd")))
        return F.translate(out.otherwise(None), "-", "#")

    new = _let(read, lambda r: _let(F.date_add(first, walk(r["day"], step, lambda v: v < DAYS).cast("int")), lambda day: F.replace(written(r["form"], day), F.lit("#"), F.regexp_extract(m, "[./-]", 0))))
    return F.coalesce(new, m)


def _iban(m: Column, key: str) -> Column:
    def new(s: Column) -> Column:
        body = F.substr(s, F.lit(5))
        digits = only(body, "0-9")
        drawn = F.when(F.length(digits) > 0, refill(body, permute_long(digits, 10, key, "iban"), "0-9")).otherwise(body)
        country = F.substr(s, F.lit(1), F.lit(2))
        check = lambda b: F.call_function("lpad", (F.lit(98) - mod97(F.concat(country, F.lit("00"), b))).cast("string"), F.lit(2), F.lit("0"))
        return _let(drawn, lambda b: F.concat(country, check(b), b))
    return _let(F.regexp_replace(m, " ", ""), lambda s: F.when(mod97(s) == 1, refill(m, new(s), "A-Z0-9")).otherwise(m))


def permute_long(text: Column, radix: int, key: str, kind: str) -> Column:
    """`permute_digits` in parts of 24, each under its place."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(.{1,24})"), 1), lambda part: permute_digits(part, radix, key, kind)), "")


def _identifier(value: Column, key: str, kind: str) -> Column:
    """Letters and digits permuted as digits in base 36; the case of letters is not kept."""
    return refill(value, permute_long(F.lower(only(value, "A-Za-z0-9")), 36, key, kind), "A-Za-z0-9")


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(_identifier(F.substr(m, F.lit(1), at - 1), key, "email"), F.substr(m, at))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, "^(?i:password|passwd|token|secret|api_?key)[ \\t]*[=:][ \\t]*[\"']?|^", 0)
    tail = F.substr(m, F.length(head) + 1)
    return F.concat(head, _identifier(tail, key, "secret"))


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "ssn": _ssn, "date": _date, "ip": _ip}


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """`docs` (doc_id, text): doc_id, the text with pseudonyms, n_<kind> per kind: values that were replaced.

    Cards (Luhn), IBANs (mod 97), social security numbers, dates from 1900 to 2099 (with a four-digit year) and IPv4
    addresses are replaced where valid, phone numbers by their form; the local part of e-mail addresses and the values of passwords, tokens and keys,
    whose form is free, are permuted as identifiers. Numbers that fail their check stay as they are. A null text stays
    null; texts without a match are returned as they are; repeated rows are replaced alike; no rows give no rows; other
    columns are ignored. Rows never leave their task.
    """
    pattern = "|".join(FORMS.values())
    found = docs.select("doc_id", "text", F.when(F.col("text").rlike(pattern), F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)).alias("_found"))

    def one(m: Column) -> Column:
        out = F
        for kind in KINDS:
            if kind == "card":
                out = out.when(m.rlike("^[0-9](?:[ -]?[0-9])*+$"), _let(_card(m, key), lambda c: F.struct(F.lit(kind).alias("kind"), c["text"].alias("new"), c["n"].alias("n"))))
            else:
                out = out.when(m.rlike(f"^(?:{FORMS[kind]})$"), F.struct(F.lit(kind).alias("kind"), MAKERS[kind](m, key).alias("new"), F.lit(1).alias("n")))
        return out.otherwise(F.struct(F.lit("").alias("kind"), m.alias("new"), F.lit(0).alias("n")))

    made = found.withColumn("_new", F.transform("_found", one))
    between = F.split("text", pattern, -1)
    joined = F.concat(F.array_join(F.zip_with(between, F.col("_new"), lambda a, n: F.concat(a, F.coalesce(n["new"], F.lit("")))), ""))
    changed = F.when(F.col("_found").isNull(), F.col("text")).otherwise(joined)
    replaced = F.filter(F.arrays_zip("_found", "_new"), lambda p: p["_found"] != p["_new"]["new"])
    kinds = F.transform(replaced, lambda p: p["_new"])

    def count(kind: str) -> Column:
        return F.coalesce(F.aggregate(kinds, F.lit(0), lambda n, v: n + F.when(v["kind"] == kind, v["n"]).otherwise(0)).cast("bigint"), F.lit(0)).alias(f"n_{kind}")

    return made.select("doc_id", changed.alias("text"), *[count(kind) for kind in KINDS])
