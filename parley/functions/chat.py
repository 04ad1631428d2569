"""Prompts and labels of conversations with a person."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PEER_CHARS = 80
_PEER = "You are texting "


def system_prompt(name: Column, peer: Column) -> Column:
    """Whom to write as, and, if known, to whom; white space in the peer's name is folded and the name cut."""
    who = F.nullif(F.trim(F.coalesce(name, F.lit(""))), F.lit(""))
    base = F.when(who.isNull() | (who == "You"), F.lit("Continue the conversation in my own style.")).otherwise(F.concat(F.lit("Continue the conversation in the style of "), who, F.lit(".")))
    folded = F.left(F.trim(F.regexp_replace(F.coalesce(peer, F.lit("")), r"(?U)\s+", " ")), F.lit(PEER_CHARS))
    return F.when(folded == "", base).otherwise(F.concat(base, F.lit(f" {_PEER}"), folded, F.lit(".")))


def opener_prompt(name: str | None = None) -> str:
    """What stands for the incoming message where the voice writes first."""
    who = "" if not name or name == "You" else f" as {name}"
    return f"Send a natural text{who} to continue or open this conversation."


def peer_of(prompt: Column) -> Column:
    """The peer that a system prompt names, or the empty text."""
    return F.regexp_extract(prompt, rf"(?s){_PEER}(.+)\.$", 1)


def peer_label(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("this contact"))
