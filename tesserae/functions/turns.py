"""Messages of a turn: role texts, the turn's content, token estimates and keys.

Messages are array<struct<role: string, content: string, blocks: array<struct<type: string, text: string>>>> in
order; content is null where a message has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string,blocks:array<struct<type:string,text:string>>>>"
MOST_CHARS = 4000


def message_text(m: Column) -> Column:
    """The content of a message, or its text blocks a line each; null where there are none."""
    blocks = F.filter(m["blocks"], lambda b: (b["type"] == "text") & b["text"].isNotNull())
    lines = F.when(F.size(blocks) > 0, F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"))
    return F.when(m["content"] != "", m["content"]).otherwise(F.when(m["content"].isNull(), lines))


def role_text(messages: Column, role: str) -> Column:
    """All texts of a role in order, a blank line between them; null if it has none."""
    texts = F.filter(F.transform(F.filter(messages, lambda m: m["role"] == role), message_text), lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n\n"))


def last_text(messages: Column, role: str) -> Column:
    """The last text of a role, or null."""
    texts = F.filter(F.transform(F.filter(messages, lambda m: m["role"] == role), message_text), lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, F.element_at(texts, -1))


def last_index(messages: Column, role: str, begin: Column) -> Column:
    """The place of the last message of a role that isn't before `begin`, or -1."""
    at = F.filter(F.transform(messages, lambda m, i: F.when((m["role"] == role) & (i >= begin), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(at), F.lit(-1))


def token_estimate(messages: Column) -> Column:
    """A quarter of the characters of all contents, rounded up; blocks count as their JSON."""
    sizes = F.transform(messages, lambda m: F.coalesce(F.length(m["content"]), F.length(F.to_json(m["blocks"])), F.lit(0)))
    return F.ceil(F.aggregate(sizes, F.lit(0), lambda s, x: s + x) / 4)


def cut(text: Column, most: Column) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), most - 3), F.lit("...")))


def cut_pair(user: Column, assistant: Column, most: int = MOST_CHARS) -> tuple[Column, Column]:
    """Both texts in `most` characters together; the longer one takes what the shorter one leaves of its half."""
    n, k, half = F.length(user), F.length(assistant), most // 2
    fits = n + k <= most
    a = F.when(fits | (n <= half), user).when(k <= half, cut(user, most - k)).otherwise(cut(user, F.lit(half)))
    b = F.when(fits | ((k <= half) & (n > half)), assistant).when(n <= half, cut(assistant, most - n)).otherwise(cut(assistant, F.lit(half)))
    return a, b


def turn_content(messages: Column) -> Column:
    """Both sides of a turn; null if one is missing, or if they are shorter than 10 and 20 characters."""
    return exchange_content(role_text(messages, "user"), role_text(messages, "assistant"))


def exchange_content(user: Column, assistant: Column) -> Column:
    trivial = (F.length(F.trim(user)) < 10) & (F.length(F.trim(assistant)) < 20)
    a, b = cut_pair(user, assistant)
    return F.when(user.isNotNull() & assistant.isNotNull() & ~trivial, F.concat(F.lit("User: "), a, F.lit("\n\nAssistant: "), b))


def user_turn_key(messages: Column) -> Column:
    """A hash of the last user message with content, and of its place; null if there is none."""
    keys = F.transform(messages, lambda m, i: F.when((m["role"] == "user") & (F.coalesce(m["content"], F.to_json(m["blocks"])) != ""), F.concat_ws(":", i.cast("string"), F.coalesce(m["content"], F.to_json(m["blocks"])))))
    keys = F.filter(keys, lambda k: k.isNotNull())
    return F.when(F.size(keys) > 0, F.sha2(F.element_at(keys, -1), 256))


def fingerprint(messages: Column, n: int) -> Column:
    """A hash of the number of messages and of the last n of them."""
    tail = F.slice(messages, F.greatest(F.size(messages) - n + 1, F.lit(1)), n)
    hashes = F.array_join(F.transform(tail, lambda m: F.sha2(F.to_json(m), 256)), "|")
    return F.sha2(F.concat(F.size(messages).cast("string"), F.lit(":"), hashes), 256)
