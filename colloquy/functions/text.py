"""Column functions over message text, reactions, files and names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token patterns of the data model. (?U) keeps \b and \d
# Unicode-aware on every Java version.
TICKET_PATTERN = r"(?U)\b[A-Z]+-\d+\b"
MENTION_PATTERN = r"<@(U[A-Z0-9]+)>"

# Weight of a channel's signal type; any other type weighs 5.
SIGNAL_WEIGHTS = {"critical": 10, "high": 8, "medium": 5, "low": 2}
DEFAULT_WEIGHT = 5


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def list_size(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0))


def ticket_ids(text: Column) -> Column:
    """Distinct ticket ids in first-seen order; an empty list when there are none."""
    found = F.regexp_extract_all(or_empty(text), F.lit(TICKET_PATTERN), F.lit(0))
    return F.array_distinct(found)


def mention_ids(text: Column) -> Column:
    """User ids mentioned in the text, repeats kept."""
    return F.regexp_extract_all(or_empty(text), F.lit(MENTION_PATTERN), F.lit(1))


def mentions_user(text: Column, user_id: str) -> Column:
    return F.coalesce(text.contains(f"<@{user_id}>"), F.lit(False))


def display_name(real_name: Column, name: Column, *fallback: Column) -> Column:
    return F.coalesce(blank_to_null(real_name), blank_to_null(name), *fallback)


def shorten(text: Column, limit: int, keep: int | None = None) -> Column:
    """Text over ``limit`` characters is cut to ``keep`` (default ``limit``) plus dots."""
    cut = F.concat(F.substring(text, 1, limit if keep is None else keep), F.lit("..."))
    return F.when(F.char_length(text) > limit, cut).otherwise(text)


def token_estimate(characters: Column) -> Column:
    """One token per four characters, rounded down."""
    return F.floor(characters / 4).cast("bigint")


def ticket_url(base: str, ticket_id: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/browse/"), ticket_id)


def reaction_text(reactions: Column) -> Column:
    """``emoji(count)`` per reaction, comma-separated."""
    return F.array_join(
        F.transform(
            reactions,
            lambda r: F.concat(
                or_empty(r["emoji"]), F.lit("("), F.coalesce(r["count"], F.lit(0)), F.lit(")")
            ),
        ),
        ", ",
    )


def file_text(files: Column, with_type: bool = True, unnamed: str = "unknown") -> Column:
    """``name (mimetype)`` per file, comma-separated; the type only when it is known."""

    def one(f: Column) -> Column:
        name = F.coalesce(f["name"], F.lit(unnamed))
        if not with_type:
            return name
        kind = blank_to_null(f["mimetype"])
        return F.when(kind.isNotNull(), F.concat(name, F.lit(" ("), kind, F.lit(")"))).otherwise(name)

    return F.array_join(F.transform(files, one), ", ")


def signal_weight(signal_type: Column) -> Column:
    chain = None
    for kind, weight in SIGNAL_WEIGHTS.items():
        step = signal_type == kind
        chain = F.when(step, weight) if chain is None else chain.when(step, weight)
    return chain.otherwise(DEFAULT_WEIGHT)


def attention_level(weight: Column) -> Column:
    """Named band of a stakeholder weight; null below the leadership band."""
    return F.when(weight >= 9, "CEO/Executive").when(weight >= 7, "Leadership")


def attention_mark(weight: Column) -> Column:
    return F.when(weight >= 9, "🔴").when(weight >= 7, "🟠").otherwise("🟡")


def signal_mark(signal_type: Column) -> Column:
    return (
        F.when(signal_type == "critical", "🔴 CRITICAL")
        .when(signal_type == "high", "🟠 HIGH")
        .when(signal_type == "low", "⚪ LOW")
        .otherwise("🟡 MEDIUM")
    )


def without_prefix(channel: Column) -> Column:
    return F.regexp_replace(channel, "channel_", "")


def rewrite_tokens(
    text: Column, pattern: str, group: int, rewrite: Callable[[Column], Column]
) -> Column:
    """Replace every token matching ``pattern`` at once.

    The text is cut in front of each token, so a replacement is never searched
    again and a token is never hit inside a longer one. ``rewrite`` maps the
    token's ``group`` to its new text, or to null to leave the token alone.
    """
    pieces = F.split(text, f"(?={pattern})")

    def one(piece: Column) -> Column:
        whole = F.regexp_extract(piece, f"^(?:{pattern})", 0)
        key = F.regexp_extract(piece, f"^(?:{pattern})", group)
        fresh = F.when(whole != "", rewrite(key))
        tail = piece.substr(F.char_length(whole) + 1, F.char_length(piece))
        return F.when(fresh.isNotNull(), F.concat(fresh, tail)).otherwise(piece)

    return F.array_join(F.transform(pieces, one), "")


def resolve_mentions(text: Column, names: Column) -> Column:
    """``<@ID>`` becomes ``@name`` for ids in the ``names`` map; others stay."""
    return rewrite_tokens(
        text, MENTION_PATTERN, 1, lambda key: F.concat(F.lit("@"), F.try_element_at(names, key))
    )


def annotate_tickets(text: Column, details: Column) -> Column:
    """``ID`` becomes ``ID [details]`` for ids in the ``details`` map; token-exact."""
    return rewrite_tokens(
        text,
        TICKET_PATTERN,
        0,
        lambda key: F.concat(key, F.lit(" "), F.try_element_at(details, key)),
    )
