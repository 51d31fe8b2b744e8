"""Publication dates: mixed spellings to zone-less timestamps, without exceptions on the way.

Each known spelling is recognised by its shape and rewritten to ISO form, which Spark's cast reads
natively. No value is ever tried against a list of formats, so bad dates cost no more than good ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.text import strip

# Month names by their first three letters.
MONTHS = {
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06",
    "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}
_MONTH_NAME = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    "sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)

DEFAULT_FORMAT = "yyyy-MM-dd HH:mm:ss"

_WEEKDAY = r"(?i)^(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?\s*,?\s+"
# Names of zones that feeds carry after a time of day.
ZONES = (
    "z utc gmt est edt cst cdt mst mdt pst pdt bst cet cest eet eest wet west msk ist jst kst hkt sgt "
    "aest aedt nzst nzdt"
).split()
# A numeric offset only follows a time of day; "05-09-2020" ends in a year.
_ZONE = (
    r"(?i)(?:(?<=\d|[ap]m|[ap]\.m\.)\s*(?:" + "|".join(ZONES) + r")|"
    r"(?<=:\d{2}(?:\.\d{1,9})?|T\d{4,6}|[ap]m)\s*(?:utc|gmt)?[+-]\d{2}(?::?\d{2})?)(?:\s*\([a-z]+\))?$"
)
_AT = r"(?i)\s+at\s+(?=\d)"
_ORDINAL = r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b"
_HALF_DAY = r"(?i)(?<=[T,\s])(\d{1,2})((?::\d{2}(?::\d{2}(?:\.\d+)?)?)?)\s*([ap])\.?m\.?$"
# Years of two digits: 00 to 68 are 2000 to 2068, the others 1969 to 1999.
_SHORT_YEAR = (
    r"(?i)^(?<a>\d{1,2}[\s-]" + _MONTH_NAME + r"\.?,?[\s-]|" + _MONTH_NAME + r"\.?\s+\d{1,2},\s*|\d{1,2}[-/.]\d{1,2}[-/.])"
    r"(?<y>%s)(?=$|[T,\s])"
)
_RECENT, _OLD = _SHORT_YEAR % r"[0-5]\d|6[0-8]", _SHORT_YEAR % r"69|[7-9]\d"
_HOUR_ONLY = r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}[T\s]\d{1,2})$"
_TIME = r"(?:[T,\s]\s*(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?$"
_YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME
_YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _TIME
_DAY_MONTH = r"(?i)^(\d{1,2})[\s-]" + _MONTH_NAME + r"\.?,?[\s-](\d{4})" + _TIME
_MONTH_DAY = r"(?i)^" + _MONTH_NAME + r"\.?\s+(\d{1,2}),?\s+(\d{4})" + _TIME
_YEAR_AFTER_TIME = r"(?i)^" + _MONTH_NAME + r"\s+(\d{1,2})\s+(\d{1,2}:\d{2}:\d{2})\s+(?:[a-z]{3,4}\s+)?(\d{4})$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_COMPACT_TIME = r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})$"
_COMPACT_SECONDS = r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})$"
_NAMED = r"^\d{4}-([A-Za-z]{3})[A-Za-z]*-"
_ISO = r"^(\d{4}-\d{1,2}-\d{1,2}(?: \d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?) ?$"


def _full_day(text: Column) -> Column:
    """A 12-hour clock as a 24-hour one; hours it does not have make the text unreadable."""

    def part(group: int) -> Column:
        return F.regexp_extract(text, _HALF_DAY, group)

    hour = part(1).try_cast("int")
    late = F.when(F.lower(part(3)) == "p", 12).otherwise(0)
    clock = F.when(hour.between(1, 12), F.lpad((hour % 12 + late).cast("string"), 2, "0"))
    minutes = F.when(part(2) == "", F.lit(":00")).otherwise(part(2))
    date = F.regexp_replace(text, _HALF_DAY, "")
    return F.when(text.rlike(_HALF_DAY), F.concat(date, clock, minutes)).otherwise(text)


def parse_date(col: Column) -> Column:
    """Zone-less timestamp of a date text, or NULL.

    A zone or offset is dropped, not converted. ``a/b/yyyy`` is month-first, and day-first only
    where month-first is impossible. Years of two digits lie between 1969 and 2068.
    """
    bare = F.regexp_replace(F.regexp_replace(strip(col), _WEEKDAY, ""), _ZONE, "")
    bare = _full_day(F.regexp_replace(F.regexp_replace(bare, _AT, " "), _ORDINAL, "$1"))
    bare = F.regexp_replace(F.regexp_replace(bare, _RECENT, "${a}20${y}"), _OLD, "${a}19${y}")
    bare = F.regexp_replace(bare, _HOUR_ONLY, "$1:00")
    bare = F.regexp_replace(bare, _COMPACT_SECONDS, "$1-$2-$3 $4:$5:$6")
    bare = F.regexp_replace(bare, _COMPACT_TIME, "$1-$2-$3 $4:$5")
    ordered = F.regexp_replace(bare, _YEAR_FIRST, "$1-$2-$3 $4")
    ordered = F.regexp_replace(ordered, _DAY_MONTH, "$3-$2-$1 $4")
    ordered = F.regexp_replace(ordered, _MONTH_DAY, "$3-$1-$2 $4")
    ordered = F.regexp_replace(ordered, _YEAR_AFTER_TIME, "$4-$1-$2 $3")
    ordered = F.regexp_replace(ordered, _COMPACT, "$1-$2-$3")
    numbers = F.create_map(*[F.lit(part) for pair in MONTHS.items() for part in pair])
    number = F.try_element_at(numbers, F.lower(F.regexp_extract(ordered, _NAMED, 1)))
    numbered = F.when(
        ordered.rlike(_NAMED),
        F.regexp_replace(ordered, F.lit("-[A-Za-z]+-"), F.concat(F.lit("-"), number, F.lit("-"))),
    ).otherwise(ordered)

    def read(order: str) -> Column:
        iso = F.regexp_extract(F.regexp_replace(numbered, _YEAR_LAST, order), _ISO, 1)
        return iso.try_cast("timestamp_ntz")

    return F.coalesce(read("$3-$1-$2 $4"), read("$3-$2-$1 $4"))


def timestamp_text(ts: Column, fmt: str = DEFAULT_FORMAT) -> Column:
    return F.date_format(ts, fmt)


def format_date(col: Column, fmt: str = DEFAULT_FORMAT) -> Column:
    """Normalised date text, or the trimmed original where it cannot be read."""
    return F.coalesce(timestamp_text(parse_date(col), fmt), strip(col))
