"""Joins of messages with user profiles and stakeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    DEFAULT_WEIGHT,
    MENTION_PATTERN,
    blank_to_null,
    display_name,
    mention_ids,
    or_empty,
    resolve_mentions,
)
from .keys import lookup

MESSAGE_KEY = ["channel", "message_id"]
LEADERSHIP_WEIGHT = 7


def name_map(messages: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, name): cached profiles, overridden by what messages say last.

    Messages are first reduced to one row per spelling of an author, which a hash
    aggregate does without sorting them.
    """
    spellings = (
        messages.filter(blank_to_null(F.col("user_id")).isNotNull())
        .groupBy("user_id", "user_real_name", "user_name")
        .agg(F.max("event_ts").alias("last_ts"))
    )
    name = display_name(F.col("user_real_name"), F.col("user_name"), F.col("user_id"))
    authors = (
        spellings.withColumn("author", name)
        .groupBy("user_id")
        .agg(F.max_by("author", F.struct("last_ts", "author")).alias("author"))
    )
    cached = users.select("user_id", name.alias("cached"))
    return authors.join(cached, "user_id", "full").select(
        "user_id", F.coalesce("author", "cached").alias("name")
    )


def has_mention(text: Column) -> Column:
    return or_empty(text).rlike(MENTION_PATTERN)


def mention_names(messages: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """(channel, message_id, mention_names): known mentioned ids of a message with their names.

    Rows that share a message id share their names.
    """
    some = messages.filter(has_mention(F.col(text)))
    ids = some.select(
        *MESSAGE_KEY, F.explode(F.array_distinct(mention_ids(F.col(text)))).alias("user_id")
    )
    found = lookup(
        ids, names.select("user_id", "name"), ["user_id"], "inner", spread=MESSAGE_KEY, large=True
    )
    return found.groupBy(*MESSAGE_KEY).agg(
        F.map_from_entries(F.collect_set(F.struct("user_id", "name"))).alias("mention_names")
    )


def with_names(text: Column) -> Column:
    """The text with ``<@ID>`` replaced by ``@name`` for the ids in ``mention_names``."""
    names = F.col("mention_names")
    return F.when(names.isNull(), text).otherwise(resolve_mentions(text, names))


def resolved(messages: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``resolved_text`` with ``<@ID>`` replaced by ``@name`` where the name is known.

    Only messages with a mention are shuffled.
    """
    some = messages.filter(has_mention(F.col(text)))
    some = some.join(mention_names(messages, names, text), MESSAGE_KEY, "left")
    some = some.withColumn("resolved_text", with_names(F.col(text))).drop("mention_names")
    plain = messages.filter(~has_mention(F.col(text))).withColumn("resolved_text", F.col(text))
    return some.select(*plain.columns).unionByName(plain)


def attach_profiles(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Adds the cached author profile as ``profile_*`` columns; null when unknown."""
    profile = users.select(
        "user_id",
        F.col("user_name").alias("profile_name"),
        F.col("user_real_name").alias("profile_real_name"),
        F.col("user_email").alias("profile_email"),
        F.col("is_bot").alias("profile_is_bot"),
    )
    return lookup(messages, profile, ["user_id"], spread=MESSAGE_KEY)


def reaction_lines(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Per message with reactions: lines ``emoji (n) by A, B`` in reaction order."""
    each = messages.select(*MESSAGE_KEY, F.posexplode("reactions").alias("r_no", "r")).select(
        *MESSAGE_KEY,
        "r_no",
        F.col("r.emoji").alias("emoji"),
        F.col("r.count").alias("n"),
        F.posexplode_outer("r.users").alias("u_no", "user_id"),
    )
    names = users.select(
        "user_id", F.coalesce("user_real_name", F.lit("Unknown User")).alias("name"),
        F.lit(True).alias("known"),
    )
    named = lookup(each, names, ["user_id"], spread=[*MESSAGE_KEY, "r_no", "u_no"])
    shown = F.when(F.col("known"), F.col("name")).when(
        F.col("user_id").isNotNull(), "Unknown User"
    )
    one = F.struct("u_no", blank_to_null(shown).alias("who"))
    lines = named.groupBy(*MESSAGE_KEY, "r_no", "emoji", "n").agg(
        F.sort_array(F.collect_list(one)).alias("by")
    )
    who = F.array_join(F.transform("by", lambda e: e["who"]), ", ")
    line = F.concat(
        or_empty(F.col("emoji")), F.lit(" ("), F.coalesce("n", F.lit(0)), F.lit(") by "), who
    )
    return (
        lines.select(*MESSAGE_KEY, F.struct("r_no", line.alias("line")).alias("e"))
        .groupBy(*MESSAGE_KEY)
        .agg(F.sort_array(F.collect_list("e")).alias("es"))
        .select(
            *MESSAGE_KEY, F.array_join(F.transform("es", lambda e: e["line"]), "\n").alias("reaction_lines")
        )
    )


def stakeholder_weights(stakeholders: DataFrame) -> DataFrame:
    """(lower_name, weight), one row per case-insensitive name."""
    return stakeholders.groupBy(F.lower("name").alias("lower_name")).agg(
        F.max(F.coalesce("weight", F.lit(DEFAULT_WEIGHT))).alias("weight")
    )


def leaders(stakeholders: DataFrame, least: int = LEADERSHIP_WEIGHT) -> DataFrame:
    return stakeholder_weights(stakeholders).filter(F.col("weight") >= least)


def author_name() -> Column:
    return display_name(F.col("user_real_name"), F.col("user_name"))


def from_leaders(messages: DataFrame, stakeholders: DataFrame) -> DataFrame:
    """Messages whose author is a stakeholder of leadership weight."""
    named = messages.withColumn("lower_name", F.lower(author_name()))
    kept = lookup(
        named, leaders(stakeholders).select("lower_name"), ["lower_name"], "left_semi",
        spread=MESSAGE_KEY,
    )
    return kept.drop("lower_name")


def author_weights(messages: DataFrame, stakeholders: DataFrame) -> DataFrame:
    """Messages per author with the author's stakeholder weight, 0 when not listed."""
    authors = messages.groupBy(author_name().alias("name")).agg(F.count("*").alias("messages"))
    weights = stakeholder_weights(stakeholders)
    return (
        authors.join(weights, F.lower("name") == F.col("lower_name"), "left")
        .select("name", "messages", F.coalesce("weight", F.lit(0)).alias("weight"))
    )


def sync_stakeholders(stakeholders: DataFrame, users: DataFrame) -> DataFrame:
    """The roster plus every user not on it yet (any case), at the default weight."""
    listed = stakeholders.select(F.lower("name").alias("lower_name")).distinct()
    name = display_name(F.col("user_real_name"), F.col("user_name"), F.lit("Unknown"))
    fresh = (
        users.select(name.alias("name"))
        .join(listed, F.lower("name") == F.col("lower_name"), "left_anti")
        .select(
            "name",
            F.lit(DEFAULT_WEIGHT).alias("weight"),
            F.lit("").alias("role"),
            F.lit("").alias("description"),
        )
    )
    old = stakeholders.select("name", "weight", "role", "description")
    return (
        old.withColumn("is_new", F.lit(False))
        .unionByName(fresh.withColumn("is_new", F.lit(True)))
        .orderBy(F.lower("name"), "name")
    )


def starter_roster(users: DataFrame, size: int = 50) -> DataFrame:
    """The first users by name, for a new roster."""
    name = display_name(F.col("user_real_name"), F.col("user_name"), F.lit("Unknown"))
    return users.select(name.alias("name"), "user_id").orderBy("name", "user_id").limit(size)


def first_stakeholders(stakeholders: DataFrame, size: int = 5) -> DataFrame:
    """The heaviest stakeholders, for a view header."""
    return stakeholders.orderBy(F.desc("weight"), "name").limit(size)


def unknown_mentions(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Ids mentioned in messages that have no profile yet."""
    ids = messages.select(F.explode(mention_ids(F.col("text"))).alias("user_id")).distinct()
    return ids.join(users.select("user_id"), "user_id", "left_anti")


def find_user(users: DataFrame, username: str) -> DataFrame:
    """The one best match: exact name, then part of the name, then part of the real name."""
    wanted = username.lower()
    name, real = F.lower("user_name"), F.lower("user_real_name")
    rank = (
        F.when(name == wanted, 1).when(name.contains(wanted), 2).when(real.contains(wanted), 3)
    )
    return (
        users.withColumn("_rank", rank)
        .filter(F.col("_rank").isNotNull())
        .agg(F.min_by("user_id", F.struct("_rank", "user_id")).alias("user_id"))
    )


GRAM = 3


def _grams(text: Column, length: Column) -> Column:
    """The different pieces of ``length`` characters of a text."""
    last = F.length(text) - length + 1
    pieces = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, length))
    return F.when(last > 0, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def find_users(users: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """The best match of each different name of a table, as :func:`find_user` finds it:
    ``(name, user_id)``, null where no user matches.

    Exact names are an equi-join. The others are looked up in an index of pieces of three
    characters (shorter names: of their own length) by their rarest piece, so that a name is held
    only against users who have that piece, and what is found is verified. Names are never held
    against all users; the empty name, which is a part of every name, gets the first user.
    """
    wanted = names.select(F.col(column).alias("name"), F.lower(column).alias("w")).distinct()
    people = users.select("user_id", F.lower("user_name").alias("n"), F.lower("user_real_name").alias("r"))
    exact = people.groupBy(F.col("n").alias("w")).agg(F.min("user_id").alias("user_id"))
    rest = wanted.join(exact, "w", "left_anti")
    named = people.select("user_id", F.lit(2).alias("rank"), F.col("n").alias("text")).unionByName(
        people.select("user_id", F.lit(3).alias("rank"), F.col("r").alias("text"))
    )
    lengths = F.array(*[F.lit(k) for k in range(1, GRAM + 1)])
    pieces = F.array_distinct(F.flatten(F.transform(lengths, lambda k: _grams(F.col("text"), k))))
    index = named.filter(F.col("text").isNotNull()).select("*", F.explode(pieces).alias("piece"))
    counts = index.groupBy("piece").agg(F.count("*").alias("n"))
    own = rest.filter(F.col("w") != "").select(
        "w", F.explode(_grams(F.col("w"), F.least(F.length("w"), F.lit(GRAM)))).alias("piece")
    )
    # a piece that no user has rules its name out
    rarest = own.join(counts, "piece", "left").groupBy("w").agg(
        F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece")
    )
    matched = rarest.join(index, "piece").filter(F.contains("text", "w"))
    by_part = matched.groupBy("w").agg(F.min(F.struct("rank", "user_id")).alias("m")).select(
        "w", F.col("m.user_id").alias("user_id")
    )
    first = named.filter(F.col("text").isNotNull()).agg(F.min(F.struct("rank", "user_id")).alias("m"))
    empty = rest.filter(F.col("w") == "").select("w").distinct()
    whole = empty.withColumn("user_id", first.select("m.user_id").scalar())
    found = exact.unionByName(by_part).unionByName(whole)
    return wanted.join(found, "w", "left").select("name", "user_id")
