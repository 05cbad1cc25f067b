"""Impact label and one sentence per feature contribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The explanation sentence of each feature.  "%d" takes the
# value as an integer, "%.2f" with two decimals, "{dir}" the direction word;
# a pair means (text when value == 1, text otherwise).
TEMPLATES: dict[str, str | tuple[str, str]] = {
    "TransactionAmt": "Transaction amount is %.2f; this feature {dir} model risk.",
    "card_avg_amount": "Historical average amount for the card is %.2f; this feature {dir} model risk.",
    "amount_vs_card_avg": "Current transaction amount is %.2fx the historical card average.",
    "card_transaction_count": "The card has %d previous transactions in the observed history.",
    "card_txn_count_1h": "The card has %d previous transactions within the preceding hour.",
    "card_txn_count_24h": "The card has %d previous transactions within the preceding 24 hours.",
    "device_unique_cards_historical":
        "The device profile was previously associated with approximately %d different cards.",
    "device_profile_count": "The device profile has appeared in %d previous transactions.",
    "device_profile_unique_cards": "The device profile has previously been associated with %d different cards.",
    "card_device_transaction_count": "This card-device combination has appeared %d times previously.",
    "card_device_seen_before": ("The card-device relationship has been observed previously.",
                                "The card-device relationship has not been observed previously."),
    "has_identity": ("Identity information is available.", "Identity information is unavailable."),
    "has_device_info": ("Device profile information is available.", "Device profile information is unavailable."),
    "missing_address": ("Address information is missing.", "Address information is present."),
    "missing_card_info": ("Some card information is missing.", "Card information is present."),
    "missing_value_count": "The transaction contains %d missing values; this missing-data pattern {dir} model risk.",
    "transaction_hour": "Transaction occurred around hour %d.",
    "transaction_day": "Transaction occurred on dataset day %d.",
    "new_card": ("This is the card's first observed transaction.", "This card has previous transaction history."),
    "new_device_profile": ("This is the first observed transaction for this device profile.",
                           "This device profile has previous history."),
}
FALLBACK = "%s has value %s; this feature {dir} model risk."


def direction(contribution: Column) -> Column:
    return F.when(contribution > 0, F.lit("increases")).otherwise(F.lit("decreases"))


def impact(contribution: Column) -> Column:
    return F.when(contribution > 0, F.lit("increases_risk")).otherwise(F.lit("decreases_risk"))


def _render(tpl: str, value: Column, contribution: Column) -> Column:
    parts = tpl.split("{dir}")
    if len(parts) == 1:
        return _fmt(tpl, value)
    return F.concat(_fmt(parts[0], value), direction(contribution), F.lit(parts[1]))


def _fmt(text: str, value: Column) -> Column:
    if "%d" in text:
        return F.format_string(text, value.cast("long"))
    if "%.2f" in text:
        return F.format_string(text, value.cast("double"))
    return F.lit(text)


def describe(feature: Column, value: Column, contribution: Column) -> Column:
    """Sentence for one (feature, value, contribution)."""
    expr = None
    for name, tpl in TEMPLATES.items():
        if isinstance(tpl, tuple):
            txt = F.when(value == 1, F.lit(tpl[0])).otherwise(F.lit(tpl[1]))
        else:
            txt = _render(tpl, value, contribution)
        expr = F.when(feature == name, txt) if expr is None else expr.when(feature == name, txt)
    head, tail = FALLBACK.split("{dir}")
    fallback = F.concat(F.format_string(head, feature, value.cast("string")), direction(contribution), F.lit(tail))
    return expr.otherwise(fallback)
