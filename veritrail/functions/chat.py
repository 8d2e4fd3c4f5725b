"""Chat assembly and rendering as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The system prompt of the training corpus ends in a newline and
# a space, the prompt used while searching in a newline only.
_PROMPT = (
    "You are a careful mathematician. Show step-by-step reasoning and label steps "
    "like 'Step 1)', 'Step 2)', etc.\n"
)
SYSTEM_PROMPTS = {"corpus": _PROMPT + " ", "search": _PROMPT}


@dataclass(frozen=True)
class ChatTemplate:
    """Turn markers; ``{role}`` in ``opening`` is replaced by the role."""

    opening: str = "<|im_start|>{role}\n"
    closing: str = "<|im_end|>\n"
    specials: tuple[str, ...] = ("<|im_start|>", "<|im_end|>")

    def open_turn(self, role: Column) -> Column:
        before, _, after = self.opening.partition("{role}")
        return F.concat(F.lit(before), role, F.lit(after))


def without_specials(text: Column, template: ChatTemplate | None = None) -> Column:
    """Rendered text as a decoder gives it back, the special tokens left out."""
    for mark in (template or ChatTemplate()).specials:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def system_prompt(profile: str = "search", unify: bool = False) -> Column:
    return F.lit(SYSTEM_PROMPTS["search" if unify else profile])


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """Two messages without an assistant text, three with one."""
    turns = [_message("system", system), _message("user", user)]
    if assistant is not None:
        turns.append(_message("assistant", assistant))
    return F.array(*turns)


def render_chat(messages: Column, mode: str = "closed", template: ChatTemplate | None = None) -> Column:
    """Text of a chat.

    ``closed`` ends every turn, ``generation`` opens a new assistant turn at
    the end, ``continue`` leaves the last turn open.
    """
    t = template or ChatTemplate()
    if mode not in ("closed", "generation", "continue"):
        raise ValueError(f"unknown chat mode {mode!r}")

    def turn(m: Column) -> Column:
        return F.concat(t.open_turn(m["role"]), m["content"])

    turns = F.transform(messages, turn)
    text = F.array_join(turns, t.closing)
    if mode == "continue":
        return text
    text = F.concat(text, F.lit(t.closing))
    if mode == "generation":
        text = F.concat(text, t.open_turn(F.lit("assistant")))
    return text
