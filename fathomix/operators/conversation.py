"""Chat logs: which platform each user turn is about.

Input rows are ``conv_id, turn, role, text``; ``turn`` is unique within a conversation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fathomix.operators.sampling import last_known_before

# The platforms and the words that name them.
PLATFORM_PATTERNS = {
    "erddap": r"\berddap\b",
    "thredds": r"\bthredds\b",
}


def mentions(text: Column, patterns: Mapping[str, str] = PLATFORM_PATTERNS) -> dict[str, Column]:
    """Per platform, whether its pattern occurs in the text (any case, Unicode words)."""
    return {name: text.rlike(f"(?iU){pattern}") for name, pattern in patterns.items()}


def detect_platforms(
    conversations: DataFrame, patterns: Mapping[str, str] = PLATFORM_PATTERNS
) -> DataFrame:
    """User turns with the sorted list of platforms they mention."""
    hits = mentions(F.col("text"), patterns)
    listed = F.array_compact(F.array(*(F.when(hits[n], F.lit(n)) for n in sorted(hits))))
    return conversations.filter("role = 'user'").select("conv_id", "turn", listed.alias("mentioned"))


def route_turns(
    conversations: DataFrame, patterns: Mapping[str, str] = PLATFORM_PATTERNS
) -> DataFrame:
    """Label every user turn ``stay``, ``switch`` or ``model`` with the platform it leaves active.

    A turn stays with the active platform unless it mentions another; a turn that mentions
    exactly one switches to it; anything else is left to the model and changes nothing. The
    active platform is thus the latest single mention. Texts are reduced to mentions before
    any row moves.
    """
    turns = detect_platforms(conversations, patterns)
    single = F.when(F.size("mentioned") == 1, F.element_at("mentioned", 1))
    marked = turns.withColumn("only", single)
    placed = last_known_before(marked, "only", ["conv_id"], "turn", "active_before")
    others = F.array_remove("mentioned", F.col("active_before"))
    sticky = F.col("active_before").isNotNull() & (F.size(others) == 0)
    decision = (
        F.when(F.coalesce(sticky, F.lit(False)), F.lit("stay"))
        .when(F.col("only").isNotNull(), F.lit("switch"))
        .otherwise(F.lit("model"))
    )
    return placed.select(
        "conv_id",
        "turn",
        F.array_join("mentioned", ",").alias("mentioned"),
        "active_before",
        decision.alias("decision"),
        F.coalesce("only", "active_before").alias("active_after"),
    )


def last_user_text(conversations: DataFrame) -> DataFrame:
    """Text of the latest user turn of every conversation, empty where there is none."""
    user_turn = F.when(F.col("role") == "user", F.col("turn"))
    return conversations.groupBy("conv_id").agg(
        F.coalesce(F.max_by("text", user_turn), F.lit("")).alias("text")
    )


def latest_entries(
    updates: DataFrame, keys: Sequence[str], sequence: str
) -> DataFrame:
    """Merge registry updates key by key; the update with the highest sequence wins.

    An update without a sequence counts as the oldest, so a key that has no other keeps it.
    """
    others = [c for c in updates.columns if c not in keys]
    place = F.struct(F.col(sequence).isNotNull(), sequence)
    newest = F.max_by(F.struct(*others), place).alias("_newest")
    return updates.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def append_entries(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Append-only list: everything there was, then everything new, duplicates included."""
    return existing.unionByName(added)
