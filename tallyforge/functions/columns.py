"""Column functions of the ledger: days, money, text predicates.  All are built-in expressions.

A date column holds a day, a local time or a time with offset as text; the precision is data, so each day
function keeps its own rule.  None depends on the session's time zone.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import fold_width

TAIPEI = 8 * 3600


def _day_in_taipei(text: Column) -> Column:
    return F.date_from_unix_date(F.floor((F.unix_seconds(F.try_to_timestamp(text)) + TAIPEI) / 86400).cast("int"))


def _prefix_day(text: Column) -> Column:
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def transaction_day(authorized: Column, posted: Column) -> Column:
    """A time of authorisation counts in Taipei; else the first ten characters of what there is."""
    timed = F.length(authorized) > 10
    return F.when(timed, F.coalesce(_day_in_taipei(authorized), _prefix_day(authorized))).otherwise(_prefix_day(F.coalesce(authorized, posted)))


def transfer_day(text: Column) -> Column:
    """Only a time with an explicit offset is moved to Taipei."""
    return F.when(text.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$"), _day_in_taipei(text)).otherwise(_prefix_day(text))


_OFFSET_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def has_offset(text: Column) -> Column:
    """A time with an explicit offset; local times count as days."""
    return F.coalesce(text.rlike(_OFFSET_TIME), F.lit(False))


def activity_day(date: Column, has_time: Column) -> Column:
    """The day in Taipei of a reliable time, else the first ten characters."""
    return F.when(has_time & has_offset(date), _day_in_taipei(date)).otherwise(_prefix_day(date))


def republican_date(text: Column) -> Column:
    """``0YYY-MM-DD`` counts from 1911."""
    year = F.when(text.startswith("0"), F.regexp_extract(text, r"^0(\d{3})-\d{2}-\d{2}", 1).try_cast("int"))
    return F.when(year.isNotNull(), F.concat((year + 1911).cast("string"), F.substring(text, 5, 1000))).otherwise(text)


def billing_day(status: Column, authorized: Column, posted: Column) -> Column:
    return F.when(status == "posted", _prefix_day(posted)).otherwise(transaction_day(authorized, posted))


def effective_date(authorized: Column, posted: Column) -> Column:
    return F.coalesce(posted, authorized, F.lit(""))


def subtract_months(day: Column, n: int) -> Column:
    """Overflows into the next month where the day does not exist (31 March less one month is 3 March)."""
    return F.date_add(F.add_months(F.trunc(day, "month"), -n), F.dayofmonth(day) - 1)


def month_before(day: Column) -> Column:
    """Clamps to the month's last day."""
    return F.add_months(day, -1)


def week_start(day: Column) -> Column:
    return F.trunc(day, "week")


def cents(x: Column) -> Column:
    """Half-up to two decimals towards plus infinity, with no negative zero."""
    return F.floor(x.cast("double") * 100 + 0.5) / F.lit(100.0) + F.lit(0.0)


def to_twd(amount: Column, currency: Column, rate: Column) -> Column:
    """Null without a positive rate; zero and TWD need none."""
    value = amount.cast("double")
    return F.when((currency == "TWD") | (value == 0), value).when(rate > 0, value * rate)


# Words of invoice statuses, of top-ups, of fees, of withdrawals.
VOID_WORDS, VALID_WORDS = "作廢|註銷|撤銷|退回|void|cancel", "開立|確認|正常|issued|confirmed"
TOP_UP = "^(?!.*手續費).*(?:電支.{0,12}儲值|(?:街口|連加|一卡通|全支付|悠遊付|全盈|icash ?pay|line ?pay).{0,8}儲值)"
FOREIGN_FEE = "國外交易服務費|國外交易手續費|海外交易手續費"
WITHDRAWAL, FEE = r"無卡提款|atm\s*提款|跨行提款|提款(?!卡|機)", r"手續費|\bfee\b"


def is_voided(status: Column) -> Column:
    """A null or blank status is valid; a void word voids; any other must have a known valid word.  Case and width do not matter."""
    text = F.nullif(F.trim(fold_width(status)), F.lit(""))
    return F.coalesce(text.rlike(f"(?iu){VOID_WORDS}") | ~text.rlike(f"(?iu){VALID_WORDS}"), F.lit(False))


def _said(description: Column, counterparty: Column) -> Column:
    return F.concat_ws(" ", F.nullif(description, F.lit("")), F.nullif(counterparty, F.lit("")))


def is_top_up(description: Column, counterparty: Column) -> Column:
    """Money put on one's own e-wallet; a fee is none."""
    return _said(description, counterparty).rlike(f"(?iu){TOP_UP}")


def is_foreign_fee(description: Column, counterparty: Column) -> Column:
    return _said(description, counterparty).rlike(FOREIGN_FEE)


def may_match(t: dict[str, Column]) -> Column:
    """Whether a payment may be the counterpart of an invoice: no top-up, no fee, not left out unless an advance, spending or not told.

    ``t``: description, counterparty, excluded, role.
    """
    role_fits = t["role"].isNull() | t["role"].isin("spending", "advance")
    counted = ~F.coalesce(t["excluded"], F.lit(False)) | F.coalesce(t["role"] == "advance", F.lit(False))
    return ~is_top_up(t["description"], t["counterparty"]) & ~is_foreign_fee(t["description"], t["counterparty"]) & counted & role_fits


def is_counted(source: Column) -> Column:
    """Sources that count in totals; trades are only listed."""
    return source.isin("bank", "card", "invoice", "cash")


def signed_amount(source: Column, amount: Column) -> Column:
    """Invoice amounts are spending whatever their sign."""
    return F.when(source == "invoice", -F.abs(amount)).otherwise(amount)


def is_excluded(preference: Column, own_kind: Column, rule: Column, default: Column) -> Column:
    """Whether a transaction is left out of totals: the user's preference, own account, card that is not synced, the rule's word, the default."""
    return F.coalesce(preference, F.when(own_kind == "own_account", True).when(own_kind == "unsynced_card", False).when(rule, True), default, F.lit(False))


def mask_long_digits(text: Column) -> Column:
    """Runs of eight digits or more keep their last four."""
    return F.regexp_replace(text, r"(?<!\d)\d{4,}(\d{4})(?!\d)", "****$1")


def merchant_key(text: Column) -> Column:
    """Letters and digits only, lower case, 120 characters at most."""
    return F.substring(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""), 1, 120)


def rule_matches(value: Column, operator: str, pattern: str) -> Column:
    """Case does not matter; a pattern that Java cannot compile matches nothing."""
    low = F.lower(value)
    if operator == "contains":
        return low.contains(pattern.lower())
    if operator == "equals":
        return low == pattern.lower()
    if operator == "starts_with":
        return low.startswith(pattern.lower())
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(f"(?iu){pattern}")
    except (Py4JJavaError, PySparkException):
        return F.lit(False)
    return value.rlike(f"(?iu){pattern}")


def direction_matches(amount: Column, direction: str) -> Column:
    return F.lit(True) if direction == "any" else amount > 0 if direction == "inflow" else amount < 0


def amount_condition(amount: Column, text: str) -> Column | None:
    """Search conditions ``>n >=n <n <=n =n a-b`` on the absolute amount; None if ``text`` is not one."""
    import re

    if m := re.fullmatch(r"(>=|<=|>|<|=)\s*(\d+(?:\.\d+)?)", text.strip()):
        size, limit = F.abs(amount).cast("double"), float(m[2])
        return {">": size > limit, ">=": size >= limit, "<": size < limit, "<=": size <= limit, "=": size == limit}[m[1]]
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*[-~]\s*(\d+(?:\.\d+)?)", text.strip()):
        return F.abs(amount).cast("double").between(*sorted((float(m[1]), float(m[2]))))
    return None


def search_condition(haystack: Column, amount: Column, text: str) -> Column:
    """An amount condition, or a text that the haystack contains; a bare number is either.  Case and width do not matter."""
    found = amount_condition(amount, text)
    if found is not None:
        return found
    folded = F.lower(fold_width(haystack)).contains(F.lower(fold_width(F.lit(text.strip()))))
    bare = text.strip().replace(",", "")
    try:
        return folded | F.coalesce(F.abs(amount).cast("double") == float(bare), F.lit(False)) if bare.replace(".", "", 1).isdigit() else folded
    except ValueError:
        return folded


def parsed_number(text: Column) -> Column:
    """Commas and currency signs go; parentheses mean negative."""
    bare = F.regexp_replace(text, r"[,$\s()]", "")
    value = bare.try_cast("decimal(18,2)")
    return F.when(text.rlike(r"^\s*\(.*\)\s*$"), -value).otherwise(value)


def parsed_date(text: Column) -> Column:
    """``/ - .`` separators or compact digits; years under 1911 count from 1911."""
    loose = lambda k: F.regexp_extract(text, r"^\s*(\d{2,4})[/.\-](\d{1,2})[/.\-](\d{1,2})\s*$", k)
    compact = text.rlike(r"^\s*\d{6,8}\s*$")
    digits = F.trim(text)
    year = F.when(compact, F.substring(digits, F.lit(1), F.length(digits) - 4)).otherwise(loose(1)).try_cast("int")
    month = F.when(compact, F.substring(digits, F.length(digits) - 3, F.lit(2))).otherwise(loose(2))
    day = F.when(compact, F.substring(digits, F.length(digits) - 1, F.lit(2))).otherwise(loose(3))
    year = F.when(year < 1911, year + 1911).otherwise(year)
    return F.try_to_date(F.format_string("%s-%s-%s", F.lpad(year.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


#: Names are ordered as in Taiwan: by strokes, Latin letters after.
LOCALE = "zh_Hant_TWN"


def localized(text: Column) -> Column:
    """``text`` so that sorts, comparisons and windows follow the locale."""
    return F.collate(text, LOCALE)
