"""Format-preserving pseudonyms: numbers and dates permuted by a keyed Feistel network inside their own format.

Native: regular expressions, higher-order functions and SHA-256 of Spark SQL. A row is rewritten where it lies; nothing is
shuffled. Each value's format is a domain ``Z_a x Z_b``, and the network adds keyed digests of one half to the other in
turn, so it is a permutation of the domain: equal values get equal pseudonyms everywhere, different ones different
pseudonyms, and ``undo`` gives the value back. Cards keep a valid check digit, dates stay dates, addresses stay addresses.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
#: Days of four Gregorian centuries (1800-01-01 to 2199-12-31): 146,097 = 189 x 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
#: Formats in the order in which they are tried. Groups that repeat without a bound are possessive: the engine
#: then goes through them in a loop, where it would else recurse once a repeat and overflow its stack on a long text.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
FORMATS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}([./])\d{2}\1\d{4})(?![\d]|[./-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<!\d)(?<!\d[ -])\d(?:[ -]?\d){12,18}(?![ -]?\d)",
}
#: The same, for finding them in a text in one pass; only one group is numbered, by its name.
ANY = "|".join(p.replace("([./])", rf"(?<sep>[./])").replace(r"\1", r"\k<sep>") for p in FORMATS.values())


#: Digits with spaces and hyphens between them, in which card numbers are looked for group by group.
RUN = r"(?<!\d)\d[\d -]{11,}\d(?!\d)"
#: Groupings of card numbers that come before all others.
GROUPINGS = ["4,4,4,4", "4,6,5", "4,6,4", "16"]


def _digest(key: str, label: Column, turn: Column, half: Column, size: Column) -> Column:
    message = F.concat_ws("|", F.lit(key), label, turn.cast("string"), half.cast("string"))
    inner = F.sha2(message, 256)
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(key), inner), 256), 1, 15), 16, 10).cast("long"), size)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, label: Column, undo: bool = False) -> Column:
    """``struct(l, r)``: the pair of ``Z_a x Z_b`` permuted under ``key``; ``label`` sets formats apart."""
    sign = -1 if undo else 1
    turns = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if undo else range(ROUNDS))])

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved = F.when(even, F.pmod(s["l"] + sign * _digest(key, label, i, s["r"], a), a)).otherwise(
            F.pmod(s["r"] + sign * _digest(key, label, i, s["l"], b), b))
        return F.struct(F.when(even, moved).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved).alias("r"))

    return F.aggregate(turns, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _digits(value: Column, key: str, label: Column, undo: bool) -> Column:
    """A string of 2 to 18 digits permuted among those of its length."""
    n = F.length(value)
    cut = (n / 2).cast("int")
    a, b = F.pow(F.lit(10), cut).cast("long"), F.pow(F.lit(10), n - cut).cast("long")
    moved = feistel(F.substring(value, F.lit(1), cut), F.substring(value, cut + 1, n - cut), a, b, key,
                    F.concat(label, n.cast("string")), undo)
    return _with(moved, lambda s: F.concat(_padded(s["l"], cut), _padded(s["r"], n - cut)))


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced one by one by those of ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"),
                        (s["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(shape, ""), start, put)["out"]


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _check_digit(payload: Column) -> Column:
    """The digit that makes ``payload`` pass the Luhn test."""
    tries = F.array(*[F.lit(str(d)) for d in range(10)])
    return F.element_at(F.filter(tries, lambda d: F.call_function("luhn_check", F.concat(payload, d))), 1)


def _card(value: Column, key: str, undo: bool) -> Column:
    plain = _only_digits(value)
    payload = _digits(F.substring(plain, F.lit(1), F.length(plain) - 1), key, F.lit("card"), undo)
    return _with(payload, lambda p: _refilled(value, F.concat(p, _check_digit(p))))


def _phone(value: Column, key: str, undo: bool) -> Column:
    plain = _only_digits(value)
    head = F.length(plain) - 10
    return _refilled(value, F.concat(F.substring(plain, F.lit(1), head),
                                     _digits(F.substring(plain, head + 1, F.lit(10)), key, F.lit("phone"), undo)))


def _ssn_parts(value: Column) -> tuple[Column, Column, Column]:
    return tuple(F.substring(value, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))


def _ssn(value: Column, key: str, undo: bool) -> Column:
    area, group, serial = _ssn_parts(value)
    index = area - 1 - (area > 666).cast("int")
    moved = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"), undo)

    def written(s: Column) -> Column:
        place = F.floor(s["l"] / 99) + 1
        return F.concat_ws("-", _padded(place + (place >= 666).cast("int"), 3), _padded(s["l"] % 99 + 1, 2),
                           _padded(s["r"] + 1, 4))

    return _with(moved, written)


def _ip(value: Column, key: str, undo: bool) -> Column:
    octet = lambda i: F.element_at(F.split(value, r"\."), i).cast("int")
    moved = feistel(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536), key, F.lit("ip"), undo)
    return _with(moved, lambda s: F.concat_ws(".", *[x.cast("int").cast("string") for half in (s["l"], s["r"])
                                                    for x in (F.floor(half / 256), half % 256)]))


def _day(value: Column) -> Column:
    """The date a match spells, NULL if there is none within the four centuries. Dots: day first; slashes: month first."""
    style = F.when(F.substring(value, 5, 1) == "-", F.try_to_date(value, "yyyy-MM-dd")).when(
        F.substring(value, 3, 1) == ".", F.try_to_date(value, "dd.MM.yyyy")).otherwise(F.try_to_date(value, "MM/dd/yyyy"))
    year = F.year(style)
    return F.when((year >= 1800) & (year < 2200), style)


def _date(value: Column, key: str, undo: bool) -> Column:
    a, b = DAYS
    first = F.lit(FIRST_DAY).cast("date")
    index = F.datediff(_day(value), first)
    moved = feistel(F.floor(index / b), index % b, F.lit(a), F.lit(b), key, F.lit("date"), undo)
    return _with(F.date_add(first, (moved["l"] * b + moved["r"]).cast("int")), lambda d: F.when(
        F.substring(value, 5, 1) == "-", F.date_format(d, "yyyy-MM-dd")).when(
        F.substring(value, 3, 1) == ".", F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")))


def _email(value: Column, key: str, undo: bool) -> Column:
    """A name has no finite format to permute: a keyed digest takes its place (it cannot be undone)."""
    name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(name), domain), 256), 1, 16),
                    F.lit("@"), domain)


REWRITE = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _valid(kind: str, value: Column) -> Column:
    if kind == "card":
        return F.call_function("luhn_check", _only_digits(value))
    if kind == "date":
        return _day(value).isNotNull()
    if kind == "ssn":
        area, group, serial = _ssn_parts(value)
        return ~area.isin(0, 666) & (area < 900) & (group > 0) & (serial > 0)
    return F.lit(True)


def kind_of(value: Column) -> Column:
    """The format of a match, NULL for one that fails its check (check digit, calendar, number ranges)."""
    out = F
    for kind, pattern in FORMATS.items():
        out = out.when(value.rlike(f"^(?:{_alone(pattern)})$") & _valid(kind, value), F.lit(kind))
    return out


def _alone(pattern: str) -> str:
    """The pattern for a match taken out of its text: what surrounds it was checked before."""
    begin = pattern.index(")") + 1 if pattern.startswith("(?<") else 0
    while pattern.startswith("(?<", begin):
        begin = pattern.index(")", begin) + 1
    end = pattern.rindex("(?!") if "(?!" in pattern else len(pattern)
    return pattern[begin:end]


def _pieces(text: Column) -> Column:
    """``text`` as an array of ``(value, found)``, where the found ones are the card numbers in its runs of digits."""
    plain = lambda c: F.array(F.struct(c.alias("value"), F.lit(False).alias("found")))
    cut = F.flatten(F.zip_with(F.split(text, RUN, -1), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda gap, run: F.when(
        run.isNull(), plain(gap)).otherwise(F.concat(plain(gap), _cards(run)))))
    return F.when(text.rlike(RUN), cut).otherwise(plain(text))


def _cards(run: Column) -> Column:
    """A run of digits cut at its separators. Of the stretches of whole groups with 13 to 19 digits and a valid check digit,
    those with a usual grouping come first, then the ones further left, then the longer; what a chosen one covers is taken."""
    joined = lambda c: F.array_join(c, "")

    def chosen(tokens: Column) -> Column:
        # every token is a group with the separator behind it; an empty group stands between two separators
        starts = F.sequence(F.lit(1), F.size(tokens))
        stretches = _with(F.transform(tokens, _only_digits), lambda groups: F.flatten(F.transform(starts, lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i + 1)),
            lambda k: F.struct(i.alias("first"), (i + k).alias("next"), F.slice(groups, i, k).alias("groups"))))))
        sized = F.filter(stretches, lambda s: F.length(joined(s["groups"])).between(13, 19) & ~F.array_contains(s["groups"], ""))
        valid = F.filter(sized, lambda s: F.call_function("luhn_check", joined(s["groups"])))
        usual = lambda s: F.array_join(F.transform(s["groups"], lambda g: F.length(g).cast("string")), ",").isin(GROUPINGS)
        ranked = F.array_sort(F.transform(valid, lambda s: F.struct(
            F.when(usual(s), 0).otherwise(1).alias("rank"), s["first"].alias("first"), (-s["next"]).alias("back"))))
        none = F.expr("cast(array() as array<struct<first:int,next:int>>)")
        return F.array_sort(F.aggregate(ranked, none, lambda taken, s: F.when(
            F.exists(taken, lambda t: (t["first"] < -s["back"]) & (s["first"] < t["next"])), taken).otherwise(
                F.concat(taken, F.array(F.struct(s["first"].alias("first"), (-s["back"]).alias("next")))))))

    def pieces(tokens: Column) -> Column:
        stretch = lambda a, b: joined(F.slice(tokens, a, b - a))
        piece = lambda value, found: F.struct(value.alias("value"), F.lit(found).alias("found"))

        def cut(taken: Column) -> Column:
            begins = F.concat(F.array(F.lit(1)), F.transform(taken, lambda t: t["next"]))
            return F.flatten(F.zip_with(begins, taken, lambda begin, t: F.when(
                t.isNull(), F.array(piece(stretch(begin, F.size(tokens) + 1), False))).otherwise(F.array(
                    piece(stretch(begin, t["first"]), False),
                    piece(F.regexp_replace(stretch(t["first"], t["next"]), "[ -]$", ""), True),
                    piece(F.regexp_extract(stretch(t["first"], t["next"]), "[ -]?$", 0), False)))))

        return _with(chosen(tokens), cut)

    return _with(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?|[ -]"), F.lit(0)), pieces)


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of one match; a match that fails its check is returned as it is."""
    kind = kind_of(value)
    out = F
    for name, rewrite in REWRITE.items():
        out = out.when(kind == name, rewrite(value, key, undo))
    return out.otherwise(value)


def pseudonymized(df: DataFrame, key: str, text: str = "text", out: str = "text", found: str = "pii",
                  undo: bool = False) -> DataFrame:
    """``df`` with the texts rewritten in ``out`` and ``found``, an array of ``(kind, pseudonym)`` in order of place.

    A null text stays null with no finds, an empty one empty. Numbers and dates that fail their check stay as they are; within
    longer runs of digits, card numbers are found group by group. Where stretches overlap that all have 13 to 19 digits,
    ``undo`` may take another one, if that one's pseudonym happens to pass the check.
    Repeated rows are rewritten alike; other columns pass through (``found`` must not be one of them).
    """
    if found in df.columns:
        raise ValueError(f"column exists: {found}")
    source = F.col(f"`{text}`")
    # what lies between matches, and a match that fails its check, may still hold card numbers beside other digits
    match = lambda m: F.when(kind_of(m).isNull(), _pieces(m)).otherwise(
        F.array(F.struct(m.alias("value"), F.lit(True).alias("found"))))
    pieces = F.flatten(F.zip_with(
        F.split(source, ANY, -1), F.regexp_extract_all(source, F.lit(ANY), F.lit(0)),
        lambda gap, m: F.when(m.isNull(), _pieces(gap)).otherwise(F.concat(_pieces(gap), match(m)))))
    parts = F.when(source.rlike("[0-9@]") & (source.rlike(ANY) | source.rlike(RUN)), F.transform(pieces, lambda p: F.struct(
        F.when(p["found"], kind_of(p["value"])).alias("kind"),
        F.when(p["found"], pseudonym(p["value"], key, undo)).otherwise(p["value"]).alias("name"))))
    cut = df.withColumn(found, parts)
    whole = F.array_join(F.transform(found, lambda p: p["name"]), "")
    kept = F.transform(F.filter(found, lambda p: p["kind"].isNotNull()),
                       lambda p: F.struct(p["kind"].alias("kind"), p["name"].alias("pseudonym")))
    return cut.withColumns({out: F.when(F.col(found).isNull(), source).otherwise(whole),
                            found: F.coalesce(kept, F.expr("cast(array() as array<struct<kind:string,pseudonym:string>>)"))})


def pseudonym_report(df: DataFrame, key: str, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Per row: the rewritten text, the count of each kind, and the pseudonyms."""
    done = pseudonymized(df.select(doc, text), key, text)
    count = lambda kind: F.size(F.filter("pii", lambda m: m["kind"] == kind))
    return done.select(doc, F.col(text).alias("text"), *[count(kind).alias(f"n_{kind}") for kind in FORMATS],
                       F.transform("pii", lambda m: F.concat_ws(":", m["kind"], m["pseudonym"])).alias("pseudonyms"))
