"""Column functions that bring source fields to canonical form, before staging.  All are built-in expressions; a
null or unreadable value gives null unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.columns import merchant_key, parsed_date

# Words and codes of the sources.
REFUND_WORDS = "退款|退貨|折讓|沖銷|回饋|繳款|還款|refund|credit|payment"
DIVIDEND_WORDS, SELL_WORDS, BUY_WORDS = "股利|股息|配息|除息|dividend", "賣出|贖回|sell", "買進|買入|申購|定期定額|buy"
CURRENCY_CODES = {"": "TWD", "000": "TWD", "NTD": "TWD", "840": "USD", "392": "JPY", "978": "EUR"}
SOURCE_RANKS = {"override": 6, "merchant_rule": 5, "user_rule": 4, "system_rule": 3, "invoice": 3, "fallback": 0}
UNMERGED_SOURCES = ("auto_transfer", "auto_offset", "own_account", "unsynced_card")
CARD_WAIT_DAYS = 10


def stable_id(*parts: Column) -> Column:
    """Parts joined by a colon; the same record always gets the same id."""
    return F.concat_ws(":", *parts)


def first_text(*values: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def statement_day(text: Column, year: Column, month: Column) -> Column:
    """``MM/DD`` of a statement: a month after the statement's is of the year before."""
    bare = F.regexp_replace(F.trim(text), "[/.]", "-")
    own = F.substring(bare, 1, 2).try_cast("int")
    return F.try_to_date(F.concat(F.when(own > month, year - 1).otherwise(year).cast("string"), F.lit("-"), bare), "yyyy-MM-dd")


def billing_period(text: Column) -> Column:
    """``YYYY-MM`` from a year of three or four digits and a month, parted or compact; years under 1911 count from 1911."""
    parts = r"^(\d{3,4})(?:[/-](\d{1,2})|(\d{2}))$"
    year = F.regexp_extract(text, parts, 1).try_cast("int")
    month = F.concat(F.regexp_extract(text, parts, 2), F.regexp_extract(text, parts, 3)).try_cast("int")
    full = F.when(year < 1911, year + 1911).otherwise(year)
    return F.when(month.between(1, 12) & full.between(2000, 2200), F.format_string("%d-%02d", full, month))


def currency_code(text: Column) -> Column:
    """Three letters; numeric codes and the local name by table; null and blank mean TWD."""
    code = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    known = F.create_map(*(F.lit(x) for pair in CURRENCY_CODES.items() for x in pair))
    return F.coalesce(F.element_at(known, code), F.when(code.rlike("^[A-Z]{3}$"), code))


def card_amount(amount: Column, description: Column) -> Column:
    """Refunds, payments and negative source amounts are inflows, all else outflows."""
    back = (amount < 0) | F.coalesce(description, F.lit("")).rlike(f"(?i){REFUND_WORDS}")
    return F.when(back, F.abs(amount)).otherwise(-F.abs(amount))


def trade_amount(quantity: Column, price: Column) -> Column:
    """Quantity times price without its fraction; a price of 1 is a placeholder and gives null."""
    return F.when(price != 1, (quantity * price).cast("bigint"))


def trade_asset_type(symbol: Column, type_code: Column) -> Column:
    return F.when(symbol.startswith("00"), "etf").when(type_code == "12", "fund").otherwise("stock")


def carrier_type(text: Column) -> Column:
    kind = F.upper(F.trim(text))
    return F.when(F.length(kind).between(1, 16), kind)


def carrier_suffix(number: Column) -> Column:
    return F.nullif(F.right(F.regexp_replace(number, r"\s+", ""), F.lit(4)), F.lit(""))


def card_last4(account_type: Column, payload: Column) -> Column:
    """Of credit accounts: the payload's four digits, else the last four of its card number without blanks and hyphens."""
    own = F.get_json_object(payload, "$.cardLast4")
    number = F.regexp_replace(F.get_json_object(payload, "$.cardNo"), r"[\s-]", "")
    return F.when(account_type == "credit", F.coalesce(F.when(own.rlike("^[0-9]{4}$"), own), F.nullif(F.regexp_extract(number, "([0-9]{4})$", 1), F.lit(""))))


def invoice_period_index(day: Column) -> Column:
    """Invoices are drawn in periods of two months, six a year."""
    return (F.year(day) * 6 + F.floor((F.month(day) - 1) / 2)).cast("int")


def invoice_period(index: Column, today: Column) -> Column:
    """Struct (label, start, end) of a period; the running one ends today."""
    year, first = F.floor(index / 6).cast("int"), (index % 6 * 2 + 1).cast("int")
    start = F.make_date(year, first, F.lit(1))
    return F.struct(F.format_string("%d/%02d-%02d", year, first, first + 1).alias("label"), start.alias("start"), F.least(F.last_day(F.add_months(start, 1)), today).alias("end"))


def names_contain(left: Column, right: Column) -> Column:
    """Equal once normalised, or one within the other where the shorter has four characters."""
    a, b = merchant_key(left), merchant_key(right)
    within = (F.least(F.length(a), F.length(b)) >= 4) & (a.contains(b) | b.contains(a))
    return F.coalesce((a != "") & (b != "") & ((a == b) | within), F.lit(False))


def investment_event(text: Column) -> Column:
    """dividend before sell before buy."""
    return F.when(text.rlike(f"(?i){DIVIDEND_WORDS}"), "dividend").when(text.rlike(f"(?i){SELL_WORDS}"), "sell").when(text.rlike(f"(?i){BUY_WORDS}"), "buy")


def source_rank(source: Column) -> Column:
    """Standing of a classification's source: unknown ones are below, absent ones level with the fallback."""
    known = F.create_map(*(F.lit(x) for pair in SOURCE_RANKS.items() for x in pair))
    return F.when(source.isNull(), 0).otherwise(F.coalesce(F.element_at(known, source), F.lit(-1)))


def takes_invoice(own_source: Column, invoice_source: Column) -> Column:
    """Whether a payment takes its invoice's category: the better ranked one; the invoice wins ties but for overrides."""
    mine, theirs = source_rank(own_source), source_rank(invoice_source)
    better = (theirs > mine) | ((theirs == mine) & (F.coalesce(own_source, F.lit("")) != "override"))
    return ~F.coalesce(own_source.isin(*UNMERGED_SOURCES), F.lit(False)) & better


def merged_category(own: Column, own_source: Column, invoice: Column, invoice_source: Column) -> Column:
    """The category of a matched pair."""
    return F.when(invoice.isNotNull() & takes_invoice(own_source, invoice_source), invoice).otherwise(own)


def match_status(outcome: Column, account_type: Column, carrier: Column, day: Column, today: Column) -> Column:
    """Struct (status, overdue) of an invoice from its matching outcome; ten days are given to a card to post."""
    waits = (outcome == "unmatched") & carrier.isNotNull()
    status = (
        F.when(outcome.isin("matched", "linked") & (account_type == "credit"), "matched_card")
        .when(outcome.isin("matched", "linked"), "matched_bank")
        .when(outcome.isin("ambiguous", "repeat"), "ambiguous")
        .when(waits, "awaiting_card")
        .otherwise("unmatched")
    )
    return F.struct(status.alias("status"), F.coalesce(waits & (F.datediff(today, day) > CARD_WAIT_DAYS), F.lit(False)).alias("overdue"))


def parsed_time(text: Column) -> Column:
    """``YYYY-MM-DD hh:mm[:ss]`` in any of the date's forms, in Taipei unless it has an offset; an impossible hour leaves the day."""
    bare = F.trim(text)
    day, clock = F.regexp_extract(bare, r"^([^ T]+)[ T]", 1), F.regexp_extract(bare, r"[ T](\d{1,2}:\d{2}(?::\d{2})?)", 1)
    zone = F.regexp_extract(bare, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    date = parsed_date(F.when(day == "", bare).otherwise(day))
    fine = clock.rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?$")
    full = F.when(F.length(F.regexp_extract(clock, "^[^:]+", 0)) == 1, F.concat(F.lit("0"), clock)).otherwise(clock)
    full = F.when(F.length(full) == 5, F.concat(full, F.lit(":00"))).otherwise(full)
    return F.when(fine, F.concat(date.cast("string"), F.lit("T"), full, F.when(zone == "", "+08:00").otherwise(zone))).otherwise(date.cast("string"))


def source_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a bar, so that codes are compared without being kept."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def first_array(payload: Column, keys: list[str], depth: int = 5) -> Column:
    """The first array in a JSON text, as JSON, looked for in the order of the text: an object's ``keys`` first, then what lies in it, ``depth`` levels down.

    Null if there is none or the text is no JSON.  An empty array under one of ``keys`` ends the search of its object, other empty ones are passed over.
    Texts keep the order of fields, variants tell arrays and objects from strings that look like them.
    """

    def in_object(text: Column, left: int) -> Column:
        fields, kinds = F.from_json(text, "map<string,string>"), F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
        array = lambda k: F.try_variant_get(kinds[k], "$", "array<variant>").isNotNull()
        named = F.coalesce(*(F.when(array(F.lit(k)), fields[F.lit(k)]) for k in keys)) if keys else F.lit(None).cast("string")
        if not left:
            return F.nullif(named, F.lit("[]"))
        below = lambda k: F.when(array(k), F.nullif(fields[k], F.lit("[]"))).when(F.try_variant_get(kinds[k], "$", "map<string,variant>").isNotNull(), in_object(fields[k], left - 1))
        inside = F.array_compact(F.transform(F.map_keys(fields), below))
        return F.when(named.isNotNull(), F.nullif(named, F.lit("[]"))).otherwise(F.get(inside, F.lit(0)))

    whole = F.try_parse_json(payload)
    return F.when(F.try_variant_get(whole, "$", "array<variant>").isNotNull(), F.nullif(payload, F.lit("[]"))).when(F.try_variant_get(whole, "$", "map<string,variant>").isNotNull(), in_object(payload, depth))


def settlement_account(broker: Column, number: Column, account: Column) -> Column:
    """Source id of a settlement account: broker and number, else the account's own id."""
    text = lambda c: F.nullif(c, F.lit(""))
    both = F.when(text(broker).isNotNull() & text(number).isNotNull(), F.concat_ws(":", F.lit("settlement"), broker, number))
    return F.coalesce(both, F.concat(F.lit("settlement:"), text(account)), F.lit("settlement:unknown"))


def movement_id(given: Column, account: Column, day: Column, amount: Column, currency: Column, description: Column, counterparty: Column) -> Column:
    """A movement's own id, else one of what tells it apart; the amount without decimals."""
    text = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    whole = F.when(amount < 0, F.ceil(amount)).otherwise(F.floor(amount)).cast("long").cast("string")
    made = F.concat_ws(":", account, text(day, "undated"), whole, text(currency, "TWD"), text(description, ""), text(counterparty, ""))
    return F.coalesce(F.nullif(given, F.lit("")), made)


def next_run(interval: Column, preferred: Column, now: Column, weekday: Column) -> Column:
    """When a job runs next: ``interval`` minutes from now below a day or without a good ``preferred`` time (HH:MM in Taipei), else at that time today or
    tomorrow, and for weeks on ``weekday`` (0: Sunday), this week or the next."""
    minute = F.make_dt_interval(mins=interval)
    hours, minutes = (F.regexp_extract(preferred, r"\A(\d{2}):(\d{2})\z", k).try_cast("int") for k in (1, 2))
    fine = F.coalesce((hours <= 23) & (minutes <= 59), F.lit(False))
    taipei = F.make_dt_interval(hours=F.lit(8))
    today = F.date_trunc("day", now + taipei)
    at = today + F.make_dt_interval(hours=hours, mins=minutes) - taipei
    ahead = F.pmod(F.least(F.lit(6), F.greatest(F.lit(0), F.coalesce(weekday, F.lit(1)))) - (F.dayofweek(today) - 1), F.lit(7))
    weekly = at + F.make_dt_interval(days=ahead)
    later = lambda x, days: F.when(x <= now, x + F.make_dt_interval(days=F.lit(days))).otherwise(x)
    return F.when((interval < 1440) | ~fine, now + minute).when(interval == 10080, later(weekly, 7)).otherwise(later(at, 1))
