"""Predicates and functions on strings, as column expressions.

All take a column (or its name) and stay inside generated code.  Null gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str
#: Separators besides ASCII punctuation, format characters and ASCII white space.
_MORE = "".join(map(chr, (0xA0, 0x2007, 0x202F, 0x3010, 0x3011, 0xF7, 2, 1, 0x2022, 0x201E, 0xE010, 0xE011)))
SEPARATOR = rf"\p{{Punct}}\p{{Cf}}\p{{Space}}{_MORE}"
BLANK = r"\s\p{Z}\x0b\x1c-\x1f"
#: The same for Python's ``re``; format characters are those of Unicode 15, as SQL has them.
FORMAT = "\xad\u0600-\u0605\u061c\u06dd\u070f\u0890\u0891\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb\U000110bd\U000110cd\U00013430-\U0001343f\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0001\U000e0020-\U000e007f"
SEPARATOR_RE = rf"!-/:-@\[-`{{-~\t-\r {FORMAT}{_MORE}"
#: What ``BLANK`` holds.
BLANKS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ROMAN = "^(?=.)M{0,3}(?:C[MD]|D?C{0,3})(?:X[CL]|L?X{0,3})(?:I[XV]|V?I{0,3})$"
TOTAL = r"^(?s:.*\s)?(?i:net|total|subtotal|estimated)(?s:\s.*)?:?$"
URL = r"(?:https?|ftp|file)://[\w\-+&@#/%?=~|!:,.;]*[\w\-+&@#/%=~|]"
NON_ALPHANUMERIC, NUMERIC, DATE, ALPHA, ALPHANUMERIC = "NON_ALPHANUMERIC", "NUMERIC", "DATE", "ALPHA", "ALPHANUMERIC"
PRIORITY = {NON_ALPHANUMERIC: 0, NUMERIC: 1, DATE: 2, ALPHA: 3, ALPHANUMERIC: 4}


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(c: C, pattern: str) -> Column:
    """Whether the whole string matches, line ends included."""
    return F.regexp_like(col(c), F.lit(rf"\A(?:{pattern})\z"))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^[{BLANK}]+", ""), f"[{BLANK}]+$", "")


def split_words(text: C, numbers: bool = False, punctuation: bool = True) -> Column:
    """Words and, if asked for, the runs of separators between them, without the white space at their ends.

    With ``numbers`` a word is cut further where digits begin and end.
    """
    word = f"[^{SEPARATOR}]+" if not numbers else f"[0-9]+|[^0-9{SEPARATOR}]+"
    pattern = f"(?:{word})" + (f"|[{SEPARATOR}]+" if punctuation else "")
    return F.filter(F.transform(F.regexp_extract_all(col(text), F.lit(f"({pattern})"), F.lit(0)), _trimmed), lambda w: w != "")


def split_indexed_words(text: C, numbers: bool = False, punctuation: bool = True) -> Column:
    """Structs of word, its index in the text from 0, and whether it is a word or separators."""
    word = f"[^{SEPARATOR}]+" if not numbers else f"[0-9]+|[^0-9{SEPARATOR}]+"
    every = F.regexp_extract_all(col(text), F.lit(f"((?:{word})|[{SEPARATOR}]+)"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:string,index:int,is_word:boolean>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        lead = F.length(w) - F.length(F.regexp_replace(w, f"^[{BLANK}]+", ""))
        found = F.struct(_trimmed(w).alias("word"), (acc["at"] + lead).cast("int").alias("index"), F.regexp_like(w, F.lit(f"^[^{SEPARATOR}]")).alias("is_word"))
        return F.struct((acc["at"] + F.length(w)).cast("int").alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    out = F.aggregate(every, start, step, lambda acc: acc["out"])
    return F.filter(out, lambda x: (x["word"] != "") & (x["is_word"] | F.lit(punctuation)))


def is_white_space(c: C) -> Column:
    """One character of white space, the no-break spaces included."""
    return matches(c, f"[{BLANK}]")


def has_alphabets(c: C) -> Column:
    return F.regexp_like(col(c), F.lit("[a-zA-Z]"))


def has_numeric_content(c: C) -> Column:
    return F.regexp_like(col(c), F.lit("[0-9]"))


def is_semantically_incomplete(c: C) -> Column:
    """A currency sign alone."""
    return col(c).isin("$", "€")


def is_number(c: C) -> Column:
    return matches(c, "[0-9]+")


def _cased(c: C, other: str) -> Column:
    return F.regexp_like(col(c), F.lit(r"\p{IsAlphabetic}")) & ~F.regexp_like(col(c), F.lit(other))


def is_upper_case(c: C) -> Column:
    """Holds a letter, and none in lower case."""
    return _cased(c, r"[\p{IsAlphabetic}&&\p{IsLowercase}]")


def is_lower_case(c: C) -> Column:
    """Holds a letter, and none in upper case."""
    return _cased(c, r"[\p{IsAlphabetic}&&\p{IsUppercase}]")


def is_roman_number(c: C) -> Column:
    """A Roman numeral in one case."""
    return F.regexp_like(col(c), F.lit(ROMAN)) | F.regexp_like(col(c), F.lit(ROMAN.lower()))


def is_number_in_any_system(c: C) -> Column:
    return is_number(c) | is_roman_number(c)


def is_alphanumeric(c: C) -> Column:
    """Only capitals, only small letters, or only digits."""
    return matches(c, "[A-Z]+|[a-z]+|[0-9]+")


def is_bullet(c: C) -> Column:
    """One geometric shape, U+25A0 to U+25FF."""
    return matches(c, "[■-◿]")


def contains_only_index(c: C) -> Column:
    """An index mark such as ``[3]``, ``XII,`` or a bullet alone."""
    c = col(c)
    end = r"[.,)\]]"
    parts = F.split(F.regexp_replace(c, f"{end}+$", ""), end)
    index = F.regexp_replace(parts[0], r"^[(\[]", "")
    # a text of end marks alone has no part; one that begins with an end mark has an empty first part
    marked = (F.size(parts) == 1) & (parts[0] != "") & (((F.length(index) <= 3) & is_alphanumeric(index)) | is_roman_number(index) | is_bullet(index))
    return F.when(F.regexp_like(c, F.lit(end)), marked).otherwise(is_bullet(F.trim(c)))


def means_total(c: C) -> Column:
    """A line that speaks of a net amount, a total or an estimate."""
    return F.regexp_like(col(c), F.lit(TOTAL))


def is_amount_or_percentage(c: C) -> Column:
    """Digits with commas and points, in brackets, after a minus or before a percent sign."""
    t = F.trim(col(c))
    t = F.when(F.startswith(t, F.lit("(")) & F.endswith(t, F.lit(")")) & (F.length(t) > 1), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    t = F.regexp_replace(t, "^[-−]", "")
    t = F.when(F.endswith(t, F.lit("%")), F.trim(F.substr(t, F.lit(1), F.length(t) - 1))).otherwise(t)
    return is_number(F.regexp_replace(t, "[.,]", ""))


def can_be_connected(c: C) -> Column:
    """The text goes on in what follows it: it ends in a colon or comma, or has a digit and ends in a point."""
    c = col(c)
    return F.endswith(c, F.lit(":")) | F.endswith(c, F.lit(",")) | (has_numeric_content(c) & F.endswith(c, F.lit(".")))


def is_last_line_of_paragraph(c: C) -> Column:
    """Ends in a point, the only one or with more than one word between it and the first."""
    c = col(c)
    head = F.substr(c, F.lit(1), F.length(c) - 1)
    at = F.instr(head, ".")
    # leading blanks count as an empty first word, trailing ones do not count
    rest = F.regexp_replace(F.substr(head, at + 1), r"\s+$", "")
    return F.endswith(c, F.lit(".")) & ((at == 0) | F.regexp_like(rest, F.lit(r"\s")))


def means_same_but_numbers(a: C, b: C) -> Column:
    """Equal words except where both have a number, Arabic or Roman."""
    x, y = split_words(a), split_words(b)
    same = F.forall(F.zip_with(x, y, lambda p, q: (p == q) | (is_number_in_any_system(p) & is_number_in_any_system(q))), lambda ok: ok)
    return (F.size(x) == F.size(y)) & same


def masked_numbers(text: C) -> Column:
    """The text with each number as one sign and the blanks between words made equal; null as empty.

    Equal where ``means_same_but_numbers`` holds, so fit for an equi-join; three passes over the text, none over its words.
    """
    roman = ROMAN[1:-1].replace("(?=.)", "(?=[MDCLXVI])")
    number = rf"(?<![^{SEPARATOR}])(?:[0-9]+|{roman}|{roman.lower()})(?![^{SEPARATOR}])"
    word, sign = rf"[^{SEPARATOR}]", rf"(?:(?![{BLANK}])[{SEPARATOR}])"
    masked = F.regexp_replace(F.coalesce(col(text), F.lit("")), number, "\uf8fe")
    # blanks at the ends of a run of signs, and of the text
    trimmed = F.regexp_replace(masked, rf"(?<={word})[{BLANK}]+(?={sign})|(?<={sign})[{BLANK}]+(?={word})|^[{BLANK}]+|[{BLANK}]+$", "")
    return F.regexp_replace(trimmed, rf"(?<={word})[{BLANK}]+(?={word})", " ")


#: Signs that numbers and blanks consist of, and the one that stands for a number in ``masked_numbers``.
_BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_NUMERALS = "0123456789MDCLXVImdclxvi" + _BLANKS + "\uf8fe"


def without_numerals(text: C) -> Column:
    """The text without signs that numbers and blanks may consist of; null as empty.

    Cheap, and equal wherever ``masked_numbers`` is, so it finds the few texts that are worth masking.
    """
    return F.translate(F.coalesce(col(text), F.lit("")), _NUMERALS, "")


# --- dates


def _date_text(c: C) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"[\s ]+", " "), "−", "-")


_SHORT = r"^([0-3]?[0-9])([/ .\-])([0-3]?[0-9])\2([0-9]{2}|[0-9]{4})$"
_BIG = r"^([0-9]{2}|[0-9]{4})([/ .\-])(?:([0-3][0-9])\2([0-3][0-9])|([1-3]?[0-9])\2([1-3]?[0-9]))$"


def _int(c: Column, pattern: str, group: int) -> Column:
    return F.expr("cast(null AS int)") if group is None else F.try_to_number(F.regexp_extract(c, pattern, group), F.lit("9999")).cast("int")


def _numeric_parts(t: Column) -> dict[str, tuple[Column, Column, Column]]:
    """Year, month and day of each numeric order, null where it does not apply."""
    a, b, y = (_int(t, _SHORT, k) for k in (1, 3, 4))
    by, m, d = _int(t, _BIG, 1), F.coalesce(_int(t, _BIG, 3), _int(t, _BIG, 5)), F.coalesce(_int(t, _BIG, 4), _int(t, _BIG, 6))
    return {"middle": (y, a, b), "little": (y, b, a), "big": (by, m, d)}


def _valid(y: Column, m: Column, d: Column, digits: Column) -> Column:
    return F.coalesce(m.between(1, 12) & d.between(1, 31) & ((y > 0) | (digits == 2)), F.lit(False))


_M, _D, _Y = "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])", "(?:[0-9]{2}|(?!0000)[0-9]{4})"
_MM, _DD = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
_SEPS = r"([/ .\-])"
#: One pattern for all three orders and lone years, so that a text is read once.
_DIGIT_DATE = (
    rf"^(?:[12][0-9]{{3}}|{_M}{_SEPS}{_D}\1{_Y}|{_D}{_SEPS}{_M}\2{_Y}|{_Y}{_SEPS}{_MM}\3{_DD}|{_Y}{_SEPS}(?:[1-9]|1[0-2])\4(?:[1-9]|[12][0-9]|3[01]))$"
)


def is_numeric_date(c: C) -> Column:
    """A date in digits in any of the three orders, or a year from 1000 to 2999."""
    # a scan tells most texts apart before their blanks and signs are made equal: a date has three numbers, or one of four digits
    return F.regexp_like(col(c), F.lit("[0-9][^0-9]+[0-9]+[^0-9]+[0-9]|^[^0-9]*[0-9]{4}[^0-9]*$")) & F.regexp_like(_date_text(c), F.lit(_DIGIT_DATE))


_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_NAME = "(?i:(" + "|".join([*_MONTHS, *[m[:3] for m in _MONTHS], "sept"]) + "))"
_DAY_FIRST = rf"^([0-3]?[0-9])([/ \-]){_NAME}(?:\2| ?, {{0,2}}|, {{0,2}})([0-9]{{4}}|[0-9]{{2}})$"
_MONTH_FIRST = rf"^{_NAME} ([0-3]?[0-9]),? {{0,2}}([0-9]{{4}})$"


def parsed_date(c: C) -> Column:
    """The date that a text is, or null: month-day-year first, then day-month-year, year-month-day, a year, month names.

    Two-digit years lie in 2000 to 2099; a day beyond its month's end is that end; a lone year is its first of January.
    """
    t = F.regexp_replace(_date_text(c), r"(?<=[0-9])\s?(?i:st|nd|rd|th)(?![a-zA-Z])", "")
    parts = _numeric_parts(t)
    short, big = F.length(F.regexp_extract(t, _SHORT, 4)), F.length(F.regexp_extract(t, _BIG, 1))

    def month(pattern: str, group: int) -> Column:
        return F.nullif(F.array_position(F.array(*[F.lit(m[:3]) for m in _MONTHS]), F.substr(F.lower(F.regexp_extract(t, pattern, group)), F.lit(1), F.lit(3))), F.lit(0)).cast("int")

    def made(y: Column, m: Column, d: Column, digits: Column) -> Column:
        year = F.when(digits == 2, y + 2000).otherwise(y)
        last = F.dayofmonth(F.last_day(F.make_date(year, m, F.lit(1))))
        return F.when(_valid(y, m, d, digits), F.make_date(year, m, F.least(d, last)))

    df, mf = F.length(F.regexp_extract(t, _DAY_FIRST, 4)), F.lit(4)
    return F.coalesce(
        made(*parts["middle"], short), made(*parts["little"], short), made(*parts["big"], big),
        F.when(F.regexp_like(t, F.lit("^[12][0-9]{3}$")), F.make_date(F.try_to_number(F.substr(t, F.lit(1), F.lit(4)), F.lit("9999")).cast("int"), F.lit(1), F.lit(1))),
        made(_int(t, _DAY_FIRST, 4), month(_DAY_FIRST, 3), _int(t, _DAY_FIRST, 1), df),
        made(_int(t, _MONTH_FIRST, 3), month(_MONTH_FIRST, 1), _int(t, _MONTH_FIRST, 2), mf),
    )


# --- kinds


def regex_type(c: C) -> Column:
    """Kind of a text by its letters, digits and dates."""
    return F.when(has_alphabets(c), F.when(has_numeric_content(c), ALPHANUMERIC).otherwise(ALPHA)).when(is_numeric_date(c), DATE).when(has_numeric_content(c), NUMERIC).otherwise(NON_ALPHANUMERIC)


def type_priority(c: C) -> Column:
    """The rank of a text's kind; 3 and more holds letters."""
    return F.when(has_alphabets(c), F.when(has_numeric_content(c), 4).otherwise(3)).when(is_numeric_date(c), 2).when(has_numeric_content(c), 1).otherwise(0)


def can_be_header(texts: C) -> Column:
    """A column's texts from the top: a lone one has letters and ends no paragraph; of several, all but the first have letters."""
    a = col(texts)
    one = has_alphabets(a[0]) & ~is_last_line_of_paragraph(a[0])
    return F.when(F.coalesce(F.size(a), F.lit(0)) <= 0, False).when(F.size(a) == 1, one).otherwise(F.forall(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(1))), has_alphabets))


def is_amount_representation(c: C, kind: Column | None = None) -> Column:
    """Digits, perhaps with one sign of currency, percentage or dash; ``kind`` is the text's ``regex_type`` where it is known."""
    c = col(c)
    sign = r"^([\s\S]*?)(?:\$|%|USD|EUR|€|-|_|−)"
    # the first sign as a nought: such a text has a digit, so letters and dates alone are left to tell
    swapped = F.regexp_replace(c, sign, "$10")
    return ((regex_type(c) if kind is None else kind) == NUMERIC) | (F.regexp_like(c, F.lit(sign)) & ~has_alphabets(swapped) & ~is_numeric_date(swapped))


# --- names, signs and marks


def normalize_locational_text(c: C) -> Column:
    """Lower case, punctuation and white space as single spaces."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[\s\p{P}]+", " "))


def is_named_entity(c: C, cities: list[str], stop: list[str] = ()) -> Column:
    """The text is a city of the list and no stop word; with an empty list, never."""
    n = normalize_locational_text(c)
    known = sorted(set(cities) - set(stop))
    return (n.isin(known) if known else F.lit(False)) & (F.length(col(c)) > 0)


#: Characters that look alike, by the plain one.
ALIKE = {
    ",": "¸؍٫‚ꓹ，", ".": "٠۰܁܂․ꓸ꘎．", "?": "Ɂʔॽ?ꛫ？", "/": "᜵⁄∕╱⟋⧸⼃〳ノ㇓丿／", "'": "`´ʹʻʼʽʾˈˊˋ˴ʹ΄՚՝י׳ߴߵᑊᛌ᾽᾿`´῾‘’‛′ꞌ＇｀́", '"': "ʺ˝ˮ˶ײ״〃“”‟″‶＂",
    ";": ";；", ":": "ː˸։׃܃܄ःઃ᛬⁚∶ꓽ꞉︰：", "\\": "∖⟍⧵⧹⼂㇔丶﹨＼", ")": "❩❳〕﴿）", "(": "❨❲〔﴾（", "}": "❵｝", "{": "❴｛", "=": "᐀⹀゠꓿＝", "+": "᛭➕＋", "-": "˗۔‐‑‒–—―\u00ad⁃−➖Ⲻ﹘", "_": "ߺ﹍﹎﹏＿",
    "*": "٭⁎∗＊", "&": "ꝸ＆", "%": "٪％", "^": "˄ˆ", "$": "＄", "!": "ǃⵑ！", ">": "›", "<": "‹",
}
_FROM, _TO = zip(*{odd: plain for plain, many in ALIKE.items() for odd in many if odd != plain}.items(), strict=True)


def normalize_homoglyphs(c: C) -> Column:
    """Signs that look like an ASCII sign become it."""
    return F.translate(col(c), "".join(_FROM), "".join(_TO))


LIGATURES = ["ff", "fi", "ffi", "ti", "tt", "th"]


def fix_null_ligatures(word: C, dictionary: Column) -> Column:
    """A word whose ligature was read as NUL: the first ligature that makes it a word of the dictionary (an array), else none."""
    w = col(word)
    tries = F.array(*[F.replace(w, F.lit("\0"), F.lit(x)) for x in LIGATURES])
    found = F.filter(tries, lambda t: F.array_contains(dictionary, F.lower(t)))
    return F.when(F.instr(w, "\0") == 0, w).otherwise(F.coalesce(F.try_element_at(found, F.lit(1)), w))


#: Signs of currency and their names.
CURRENCY = {
    "$": "DOLLAR", "¢": "CENT", "£": "POUND", "¤": "CURRENCY", "¥": "YEN", "֏": "ARMENIAN DRAM", "؋": "AFGHANI", "৳": "BENGALI RUPEE", "฿": "BAHT", "₡": "COLON", "₢": "CRUZEIRO", "₣": "FRENCH FRANC", "₤": "LIRA", "₦": "NAIRA", "₧": "PESETA", "₨": "RUPEE", "₩": "WON", "₪": "NEW SHEQEL",
    "₫": "DONG", "€": "EURO", "₭": "KIP", "₮": "TUGRIK", "₱": "PESO", "₲": "GUARANI", "₴": "HRYVNIA", "₵": "CEDI", "₸": "TENGE", "₹": "INDIAN RUPEE", "₺": "TURKISH LIRA", "₼": "MANAT", "₽": "RUBLE", "₾": "LARI", "₿": "BITCOIN", "﷼": "RIAL", "＄": "FULLWIDTH DOLLAR", "￡": "FULLWIDTH POUND", "￥": "FULLWIDTH YEN",
}


def currency_symbol(c: C) -> Column:
    """The first sign of currency in a text, or null."""
    return F.nullif(F.regexp_extract(col(c), f"([{''.join(CURRENCY)}])", 1), F.lit(""))


def currency_name(symbol: C) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CURRENCY.items() for x in pair]), col(symbol))


FACTORS = {"hundreds": 100, "thousands": 1000, "millions": 1_000_000}


def multiplicative_factor(c: C, compat_millions: bool = False) -> Column:
    """100, 1000 or 1000000 where a text says ``(in hundreds)`` and the like, else 1; in compatible mode millions are 100000."""
    word = F.lower(F.regexp_extract(col(c), r"(?i)\([a-z]*\s?in\s([a-z]+)\)", 1))
    out = F.lit(1)
    for name, value in FACTORS.items():
        out = F.when(word == name, 100_000 if compat_millions and name == "millions" else value).otherwise(out)
    return out


_STATEMENTS = {"Income Statement": r"(?:statement|result)s?\s+of\s+(?:operations|income)", "Balance Sheet": r"balance\s+sheets?", "Cash Flows Statement": r"statements?\s+of\s+cash\s+flows?"}


def statement_type(caption: C) -> Column:
    """Kind of financial statement that a caption names, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(_STATEMENTS.items()):
        out = F.when(F.regexp_like(col(caption), F.lit(f"(?i){pattern}")), name).otherwise(out)
    return out


def is_consolidated(caption: C) -> Column:
    """The caption names a consolidated statement."""
    return F.regexp_like(col(caption), F.lit(r"(?i)consolidated\s*(?:" + "|".join(_STATEMENTS.values()) + ")"))


def is_page_number(c: C) -> Column:
    """A page number such as ``12``, ``iv``, ``3-12`` or ``page - 4``: parts between dashes, of which the last is a number.

    An earlier part may be one sign or hold letters.
    """
    parts = F.transform(F.split(F.regexp_replace(col(c), "-+$", ""), "-"), lambda p: F.trim(p))
    odd = F.exists(parts, lambda p: ~is_number_in_any_system(p) & (F.length(p) != 1) & ~has_alphabets(p))
    return ~odd & is_number_in_any_system(F.element_at(parts, -1))


def is_dash_wrapped(c: C) -> Column:
    """Ends in a dash after something that is none."""
    return F.regexp_like(col(c), F.lit(r"[^\p{Pd}].*\p{Pd}$"))


def is_unique_cell(c: C) -> Column:
    """Ends in a colon, stands in brackets with up to four characters, or is a dash."""
    return F.regexp_like(col(c), F.lit(r":$|^\(.{1,4}\)$|^-$"))


def starts_as_header(line: C) -> Column:
    """A running head by its look: a link, or a line that begins with ``date``."""
    return F.regexp_like(col(line), F.lit(URL)) | F.regexp_like(col(line), F.lit(r"^\s*(?i:date)\b"))


def continues_on_next_page(line: C) -> Column:
    return F.regexp_like(col(line), F.lit(r"(?i)continue[sd]?\s+on\s+(?:the\s+)?next\s+page"))


# --- numbers, colours, forms


def floor2(c: C) -> Column:
    """Down to two decimals, in binary arithmetic."""
    return F.floor(col(c) * 100) / 100


def format_length(c: C, unit: str = "pt") -> Column:
    """A length with at most two decimals (three in em) and its unit."""
    d = 3 if unit == "em" else 2
    return F.concat(F.regexp_replace(F.regexp_replace(F.format_string(f"%.{d}f", F.round(col(c).cast("double"), d)), "0+$", ""), r"\.$", ""), F.lit(unit))


def hex_color(rgb: C) -> Column:
    """``#RRGGBB`` of a packed colour."""
    return F.concat(F.lit("#"), F.lpad(F.hex(col(rgb).bitwiseAND(0xFFFFFF)), 6, "0"))


def luminance(rgb: C) -> Column:
    """Brightness of a packed colour, 0 to 1."""
    c = col(rgb)
    part = lambda shift: F.shiftright(c, shift).bitwiseAND(255)
    return (part(16) * 0.299 + part(8) * 0.587 + part(0) * 0.114) / 255


def html_escape(c: C) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def form_is_checked(form: C) -> Column:
    """A box is checked when it has no on-values or one of them is its value."""
    f = col(form)
    return f["on"].isNull() | F.exists(f["values"], lambda v: F.array_contains(f["on"], v))


def form_flag(form: C, name: str, default: bool = False) -> Column:
    return F.coalesce(F.try_element_at(col(form)["flags"], F.lit(name)), F.lit(default))


def form_text(form: C) -> Column:
    return F.array_join(col(form)["values"], ",")
