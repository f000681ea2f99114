"""Year candidates of a text: literal years, fiscal labels, ranges and calendar eras.

The text is read number group by number group ("2024", "2014/15", "2010-2012-2014"):
what stands before and after a group says what it is. Digits of any script
count by their value; offsets are those of the text.
"""

from __future__ import annotations

import sys
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Windows, era offsets, the pivot of two-digit years.
LITERAL_WINDOW, LABEL_WINDOW = (2015, 2030), (1900, 2099)
BUDDHIST, BUDDHIST_FROM, MINGUO, REIWA, HEISEI, PIVOT = 543, 2400, 1911, 2018, 1988, 25
# Markers of fiscal years before and after the year.
BEFORE = (
    "Haushaltsjahr", "Geschäftsjahr", "Rechnungsjahr", "Wirtschaftsjahr", "Doppelhaushalt", "exercice budgétaire", "exercice financier",
    "exercice fiscal", "année fiscale", "année budgétaire", "ejercicio fiscal", "ejercicio presupuestario", "año fiscal", "anno fiscale",
    "esercizio finanziario", "exercício financeiro", "exercício fiscal", "ano fiscal", "begrotingsjaar", "boekjaar",
)
AFTER = ("年度", "财年", "財年", "财政年度", "財政年度", "会计年度", "會計年度", "회계연도")

_GAP = "[  ]"
_JOIN = rf"{_GAP}?[-/‐-―]{_GAP}?"
_GROUP = regex.compile(rf"(?<![0-9])[0-9]{{2,4}}(?![0-9])(?:{_JOIN}[0-9]{{2,4}}(?![0-9]))*")
_LINK = regex.compile(rf"{_GAP}+(?:to|through|until){_GAP}+", regex.I)


def _ending(pattern: str, flags: int = 0) -> regex.Pattern:
    """To be matched at a place: what stands right before it, however long."""
    return regex.compile(f"(?<={pattern})", flags)


_FY = _ending(rf"(?:\bF\.?Y\.?[\x20\xA0-]?['’]?|\b(?:fiscal|financial){_GAP}+year{_GAP}+)", regex.I)
_FISCAL = _ending(rf"\bfiscal{_GAP}+", regex.I)
_BEFORE = _ending(rf"(?:\b(?:{'|'.join(w.replace(' ', f'{_GAP}+') for w in BEFORE)}){_GAP}+|회계연도[\x20\xA0\u3000]*)", regex.I)
_THAI = _ending(rf"ปีงบประมาณ{_GAP}*(?:พ\.{_GAP}?ศ\.{_GAP}*)?")
_AFTER = regex.compile(rf"{_GAP}+(?:fiscal|financial){_GAP}+year(?![A-Za-z])|[\x20\xA0\u3000]?(?:{'|'.join(AFTER)})", regex.I)
_BE = rf"(?:พ\.{_GAP}?ศ\.|\bB\.{_GAP}?E\.)"
_BE_BEFORE, _BE_AFTER = _ending(rf"{_BE}{_GAP}?"), regex.compile(rf"{_GAP}?{_BE}")
# What marks a number as a page, an id, a paragraph.
_NUMBERING = _ending(rf"(?:\bpp?\.|\bpage|\bID|\bNo\.|#|\bart\.|§){_GAP}*", regex.I)
_ERA = regex.compile(r"(令和|平成|民[國国])[\x20\xA0\u3000]?(元|[0-9]{1,3}(?![0-9])|[〇零一二三四五六七八九十百]{1,5})[\x20\xA0\u3000]?年")
_HAN_DIGITS = str.maketrans("〇零一二三四五六七八九", "00123456789")
_TO_ASCII = {c: str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1) if chr(c).isdecimal()}


def plain_digits(text: str) -> str:
    """Every decimal digit of any script as its ASCII digit, place by place."""
    return text.translate(_TO_ASCII)


def two_digit_year(yy: int, reference_year: int) -> int:
    """The year of the 2000s, or a century before where that is PIVOT or more years ahead in its century."""
    return 2000 + yy - 100 * (yy - reference_year % 100 >= PIVOT)


def han_number(number: str) -> int:
    """元 is 1; otherwise digits place by place, or hundreds and tens with their signs (a sign alone is one of them)."""
    if number == "元":
        return 1
    rest, total = number.translate(_HAN_DIGITS), 0
    for sign, weight in (("百", 100), ("十", 10)):
        head, found, tail = rest.partition(sign)
        if found:
            total, rest = total + weight * int(head or 1), tail
    return total + int(rest or 0)


def mine_years(text: str, reference_year: int) -> list[tuple[int, int, int, str]]:
    """Sorted distinct (year, start, end, form)."""
    norm, out = plain_digits(text), set()

    def lifted(year, start, end, form, window=LABEL_WINDOW):
        if window[0] <= year <= window[1] or LITERAL_WINDOW[0] <= year <= LITERAL_WINDOW[1]:
            out.add((year, start, end, form))

    def whole(digits):
        return int(digits) if len(digits) == 4 else two_digit_year(int(digits), reference_year)

    def later(digits, first):
        """The end of a range: whole, or the first year from ``first`` on with these two digits."""
        return int(digits) if len(digits) == 4 else first + (int(digits) - first) % 100

    for m in _ERA.finditer(norm):
        base = {"令": REIWA, "平": HEISEI, "民": MINGUO}[m[1][0]]
        lifted(base + han_number(m[2]), *m.span(), "roc" if base == MINGUO else "era_jp")

    groups = list(_GROUP.finditer(norm))
    for g, m in enumerate(groups):
        parts = [(p[0], m.start() + p.start(), m.start() + p.end()) for p in regex.finditer("[0-9]+", m[0])]
        sizes = [len(d) for d, _, _ in parts]
        for digits, start, end in parts:
            if len(digits) == 4:
                lifted(int(digits), start, end, "literal", LITERAL_WINDOW)
        fy = bool(_FY.match(norm, m.start())) or (sizes[0] == 4 and bool(_FISCAL.match(norm, m.start())))
        thai = bool(_THAI.match(norm, m.start()))
        before = fy or thai or bool(_BEFORE.match(norm, m.start()))
        spans = []
        if before and 3 not in sizes and (sizes[0] == 4 or fy):
            if len(parts) <= 2:
                spans = [parts]
            elif len(parts) == 4 and sizes[0] == sizes[2] == 4:  # FY 2014/15-2019/20
                spans = [parts[:2], parts[2:]]
        elif len(parts) <= 2 and sizes[0] == 4 and 3 not in sizes and _AFTER.match(norm, m.end()):
            spans = [parts]
        for span in spans:
            first = whole(span[0][0])
            era = BUDDHIST if thai and first >= BUDDHIST_FROM else 0
            years = [first, *(later(d, first) if era else whole(d) for d, _, _ in span[1:])]
            for year, form in zip(years, ("fiscal_one",) if len(years) == 1 else ("fiscal_lower", "fiscal_upper")):
                lifted(year - era, span[0][1], span[-1][2], form)
        buddhist = bool(_BE_BEFORE.match(norm, m.start()) or _BE_AFTER.match(norm, m.end())) and not thai
        if buddhist and len(parts) <= 2 and sizes[0] == 4 and 3 not in sizes:
            first = int(parts[0][0])
            for year in (first, *(later(d, first) for d, _, _ in parts[1:])):
                lifted(year - BUDDHIST, *m.span(), "buddhist_era")
        if spans or buddhist:
            continue
        years = [int(d) for d, _, _ in parts]
        forward = set(sizes) == {4} and all(a < b for a, b in zip(years, years[1:]))
        window = LITERAL_WINDOW if _NUMBERING.match(norm, m.start()) else LABEL_WINDOW
        if len(parts) > 1 and forward:
            for (_, start, _), (_, _, end), low, high in zip(parts, parts[1:], years, years[1:]):
                lifted(low, start, end, "range_lower", window)
                lifted(high, start, end, "range_upper", window)
        follower = groups[g + 1] if g + 1 < len(groups) else None
        if follower and sizes == [4] and regex.fullmatch("[0-9]{4}", follower[0]) and _LINK.fullmatch(norm, m.end(), follower.start()) and years[0] < int(follower[0]):
            lifted(years[0], m.start(), follower.end(), "range_lower", window)
            lifted(int(follower[0]), m.start(), follower.end(), "range_upper", window)
    return sorted(out)


def year_rows(texts: DataFrame, key: str, text: str, reference_year: int) -> DataFrame:
    """(key, year, start, end, form): one row per candidate and place; null texts have none."""
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def mine(batches):
        for batch in batches:
            keys, found = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = mine_years(t or "", reference_year)
                keys += [k] * len(hits)
                found += hits
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string())))], ["key", "year", "start", "end", "form"])

    return rows.mapInArrow(mine, f"key {kind}, year int, start int, end int, form string")
