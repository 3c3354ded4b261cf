"""Pay: period words, validity rules and the stored columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanwork.functions import documents as D
from gleanwork.functions.binding import let
from gleanwork.schemas import PAY_PERIODS

# The words that name each period.
PERIOD_WORDS = {
    "year": "year|years|yearly|annual|annually",
    "month": "month|months|monthly",
    "week": "week|weeks|weekly",
    "day": "day|days|daily",
    "hour": "hour|hours|hourly",
}
# What a DECIMAL(12,2) column can hold without rounding to zero.
MAX_AMOUNT = 9999999999.99
MIN_AMOUNT = 0.005

# Names of the validity rules, in the order they are checked.
RULES = (
    "not_an_object",
    "wrong_keys",
    "min_not_positive",
    "max_not_positive",
    "no_bound",
    "min_over_max",
    "min_too_large",
    "min_rounds_to_zero",
    "max_too_large",
    "max_rounds_to_zero",
    "bad_currency",
    "bad_period",
)


def pay_period(text: Column) -> Column:
    """The one period a text names as a whole word; null for none or several."""

    def named(lowered: Column) -> Column:
        found = F.array(
            *[
                F.when(lowered.rlike(rf"(?U)\b({words})\b"), F.lit(period))
                for period, words in PERIOD_WORDS.items()
            ]
        )
        return F.filter(found, lambda period: period.isNotNull())

    return let(
        let(F.lower(text), named), lambda periods: F.when(F.size(periods) == 1, F.element_at(periods, 1))
    )


def pay_violation(pay: Column) -> Column:
    """The first broken rule of a VARIANT pay value, or null when it is valid or absent."""

    def not_positive(bound: Column) -> Column:
        amount = bound["amount"]
        return bound["given"] & ~F.coalesce((amount > 0) & (amount < float("inf")), F.lit(False))

    def bound(name: str) -> Column:
        return let(
            D.field(pay, f"$.{name}"),
            lambda v: F.struct((~D.is_absent(v)).alias("given"), D.as_number(v).alias("amount")),
        )

    def first_broken(low: Column, high: Column) -> Column:
        least, most = low["amount"], high["amount"]
        keys = F.array(*[F.lit(k) for k in ("currency", "max", "min", "period")])
        names = F.map_keys(D.entries(pay))
        currency = D.as_string(D.field(pay, "$.currency"))
        period = D.as_string(D.field(pay, "$.period"))
        checks = [
            names.isNull(),
            F.array_sort(names) != keys,
            not_positive(low),
            not_positive(high),
            ~low["given"] & ~high["given"],
            least > most,
            least > MAX_AMOUNT,
            least < MIN_AMOUNT,
            most > MAX_AMOUNT,
            most < MIN_AMOUNT,
            ~F.coalesce(currency.rlike(r"^[A-Z]{3}\z"), F.lit(False)),
            ~F.coalesce(period.isin(*PAY_PERIODS), F.lit(False)),
        ]
        return F.coalesce(*[F.when(check, F.lit(name)) for name, check in zip(RULES, checks)])

    return F.when(
        ~D.is_absent(pay),
        let(bound("min"), lambda low: let(bound("max"), lambda high: first_broken(low, high))),
    )


PAY_COLUMNS = ("pay_min", "pay_max", "pay_currency", "pay_period")


def stored_pay(pay: Column) -> Column:
    """A struct of the four stored columns, null unless the value is valid."""

    def amount(name: str) -> Column:
        return F.try_variant_get(pay, f"$.{name}", "double").try_cast("decimal(12,2)").alias(f"pay_{name}")

    def word(name: str) -> Column:
        return F.try_variant_get(pay, f"$.{name}", "string").alias(f"pay_{name}")

    return F.when(
        ~D.is_absent(pay) & pay_violation(pay).isNull(),
        F.struct(amount("min"), amount("max"), word("currency"), word("period")),
    )


def pay_columns(pay: Column) -> dict[str, Column]:
    """The four stored columns, all null unless the value is valid."""
    stored = stored_pay(pay)
    return {name: stored[name] for name in PAY_COLUMNS}


def pay_struct(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """The served object; null unless currency, period and a bound are set."""
    complete = currency.isNotNull() & period.isNotNull() & (low.isNotNull() | high.isNotNull())
    return F.when(
        complete,
        F.struct(
            low.cast("double").alias("min"),
            high.cast("double").alias("max"),
            currency.alias("currency"),
            period.alias("period"),
        ),
    )


def hundredths(value: Column) -> Column:
    """A JSON number in minor units as major units; null for every other kind."""
    return D.as_number(value) / 100


# Narrow symbols of the English locale; other codes are written out.
CURRENCY_SYMBOLS = {
    "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "INR": "₹", "CNY": "CN¥", "KRW": "₩",
    "BRL": "R$", "CAD": "CA$", "AUD": "A$", "MXN": "MX$", "NZD": "NZ$", "HKD": "HK$",
    "TWD": "NT$", "ILS": "₪", "VND": "₫", "PHP": "₱", "XCD": "EC$", "XAF": "FCFA",
    "XPF": "CFPF",
}


def _amount(value: Column, currency: Column) -> Column:
    symbols = F.create_map(*[F.lit(x) for pair in CURRENCY_SYMBOLS.items() for x in pair])
    symbol = F.coalesce(F.try_element_at(symbols, currency), F.concat(currency, F.lit("\u00a0")))
    whole = value == F.floor(value)
    return F.concat(
        symbol,
        F.when(whole, F.format_number(value, 0)).otherwise(F.format_number(F.round(value, 2), 2)),
    )


def format_pay(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """Display text: `from X/p`, `up to X/p`, `X/p` or `X – Y/p`."""
    per = F.concat(F.lit("/"), period)
    return (
        F.when(high.isNull(), F.concat(F.lit("from "), _amount(low, currency), per))
        .when(low.isNull(), F.concat(F.lit("up to "), _amount(high, currency), per))
        .when(low == high, F.concat(_amount(low, currency), per))
        .otherwise(F.concat(_amount(low, currency), F.lit(" – "), _amount(high, currency), per))
    )
