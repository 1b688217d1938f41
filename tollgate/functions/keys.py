"""Proxy account keys that degrade through named tiers when parts are missing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

KeyColumns = tuple[Column, Column]

# Tier names, their key letters and the separator.
FULL, NO_ADDR, NO_CARD_START, CARD_ONLY, SINGLETON = (
    "full", "no_addr", "no_card_start", "card_only", "singleton")
SEPARATOR = "|"


def whole_number(col: Column) -> Column:
    """Numeric part of a key as a long. Rounds half away from zero where a plain cast truncates."""
    return col.cast("decimal(38,0)").cast("long")


def card_start_day(day: str = "txn_day", age_days: str = "d1") -> Column:
    """Day the card was first seen; null when its age is unknown."""
    return F.col(day) - whole_number(F.col(age_days))


def _joined(letter: str, *parts: Column) -> Column:
    # concat, unlike concat_ws, turns null when any part is null.
    pieces: list[Column] = [F.lit(letter)]
    for part in parts:
        pieces += [F.lit(SEPARATOR), part.cast("string")]
    return F.concat(*pieces)


def account_key(card: str = "card1", addr: str = "addr1", day: str = "txn_day",
                age_days: str = "d1", row_id: str = "transaction_id") -> KeyColumns:
    """``(account_id, tier)`` of the standard five-tier key.

    The rungs are tried from the most to the least specific. A rung's key is null as soon as one
    of its parts is, so ``coalesce`` picks the first rung whose parts are all there.
    """
    c = whole_number(F.col(card))
    a = whole_number(F.col(addr))
    s = card_start_day(day, age_days)
    rungs = [
        (FULL, _joined("F", c, a, s)),
        (NO_ADDR, _joined("N", c, s)),
        (NO_CARD_START, _joined("D", c, a)),
        (CARD_ONLY, _joined("C", c)),
        (SINGLETON, _joined("X", F.col(row_id))),
    ]
    account_id = F.coalesce(*[key for _, key in rungs])
    tier = F.coalesce(*[F.when(key.isNotNull(), F.lit(name)) for name, key in rungs])
    return account_id, tier


def prefix_key(parts: Sequence[Column], letter: str, row_id: str = "transaction_id") -> KeyColumns:
    """Key from the longest non-null prefix of ``parts``; the tier is ``depth_<n>``.

    A null part cuts off every later part. With no part at all the row is its own account.
    """
    rungs = [(f"depth_{n}", _joined(f"{letter}{n}", *parts[:n])) for n in range(len(parts), 0, -1)]
    rungs.append((SINGLETON, _joined("X", F.col(row_id))))
    account_id = F.coalesce(*[key for _, key in rungs])
    tier = F.coalesce(*[F.when(key.isNotNull(), F.lit(name)) for name, key in rungs])
    return account_id, tier


def is_degraded(tier: str | Column = "account_key_tier") -> Column:
    """True for every tier but ``full``. All ``depth_*`` tiers therefore count as degraded."""
    return (F.col(tier) if isinstance(tier, str) else tier) != F.lit(FULL)


def key_catalogue(email: str = "p_emaildomain") -> Mapping[str, Callable[[], KeyColumns]]:
    """The six candidate keys of the bake-off, by name."""
    def num(name: str) -> Column:
        return whole_number(F.col(name))

    return {
        "standard": account_key,
        "card": lambda: prefix_key([num("card1")], "K"),
        "card_start": lambda: prefix_key([num("card1"), card_start_day()], "S"),
        "card_addr_start_card2": lambda: prefix_key(
            [num("card1"), num("addr1"), card_start_day(), num("card2")], "W"),
        "card_addr_start_email": lambda: prefix_key(
            [num("card1"), num("addr1"), card_start_day(), F.col(email)], "E"),
        "all_cards_addr_start": lambda: prefix_key(
            [num("card1"), num("card2"), num("card3"), num("card5"), num("addr1"),
             card_start_day()], "M"),
    }
