"""Fixed values and job parameters."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

# ---------------------------------------------------------------- fixed values
# Results depend on these being exactly so.

CHARS_PER_TOKEN = 4
LIMIT_SHARE = 0.75

# String values of these keys are translated inside JSON cells.
TRANSLATE_KEYS = (
    "content", "text", "summary", "description", "question", "answer",
    "input", "output", "response", "message", "instruction", "completion",
)

# These keys and everything below them are left alone.
SKIP_KEYS = (
    "role", "id", "name", "type", "model", "source", "lang", "language",
    "timestamp", "created_at", "updated_at", "index", "metadata",
)

SOURCE_LANGS = ("en", "de", "fr", "es", "ru", "ar", "zh", "ja", "ko", "it", "pt")
TARGET_LANGS = ("tr", "en", "de", "fr", "es", "ru", "ar", "zh", "ja")
DEFAULT_SOURCE_LANG = "en"
DEFAULT_TARGET_LANG = "tr"

MIN_MAX_TOKENS = 128
MAX_MAX_TOKENS = 32768
DEFAULT_MAX_TOKENS = 4096

MAX_ATTEMPTS = 3
RETRY_WAIT_SECONDS = 2.0

JSON_MODES = ("auto", "force", "off")

DEFAULT_SYSTEM_PROMPT = (
    "Above, you see a text in {source}. Please translate it to {target}. "
    "Do not print the original text, just the translation.\n\n"
    "Follow the following instructions:\n\n"
    "Ensure the translation accurately reflects the original text's meaning.\n"
    "The translation should have correct grammar, including proper sentence structure, "
    "verb conjugation, punctuation, and the correct use of articles.\n"
    "The translation should read naturally and fluently as if originally written in the "
    "target language. Avoid awkward phrasing or literal translations that sound unnatural.\n"
    "Pay special attention to proper nouns and specific terms. Names of people, places, "
    "organizations, and other terms that should not be translated must be handled with care "
    "to maintain their original meaning and recognition.\n"
    "Ensure that the translation maintains the original text's tone and style."
)

# (system prompt, message template) by kind of model.
PROMPT_PRESETS = {
    "general": (DEFAULT_SYSTEM_PROMPT, "{text}"),
    "translation_model": ("", "{src} to {tgt}: {text}"),
}

# Whitespace as Python's str.strip, str.split and re's \s see it. Java's \s is
# ASCII-only, and its Unicode form leaves out U+001C..U+001F.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_SET = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACE_SET}]"

# Text is cut at the first of these that gives more than one part.
BOUNDARIES = (
    f"(?<=[.!?]){SPACE}+",  # sentence end
    r"\n\n+",               # blank line
    r"\n+",                 # line
    f"(?<=[;:]){SPACE}+",   # clause
    f"(?<=,){SPACE}+",      # comma
)

# ------------------------------------------------------------- derived numbers


def token_limit(max_tokens: int) -> float:
    """Estimated tokens a chunk may hold; the rest is left for the prompt."""
    return max_tokens * LIMIT_SHARE


def char_budget(max_tokens: int) -> int:
    """Longest text, in characters, whose token estimate is within the limit."""
    whole = math.floor(token_limit(max_tokens))
    return CHARS_PER_TOKEN * whole + CHARS_PER_TOKEN - 1 if whole >= 1 else 0


# -------------------------------------------------------------- job parameters


@dataclass(frozen=True)
class JobParams:
    """What decides the result of a translation, apart from the backend."""

    source_lang: str = DEFAULT_SOURCE_LANG
    target_lang: str = DEFAULT_TARGET_LANG
    max_tokens: int = DEFAULT_MAX_TOKENS
    json_mode: str = "auto"
    translate_keys: tuple[str, ...] = TRANSLATE_KEYS
    skip_keys: tuple[str, ...] = SKIP_KEYS
    system_prompt: str = DEFAULT_SYSTEM_PROMPT
    message_template: str = "{text}"
    model: str = "default"
    max_attempts: int = MAX_ATTEMPTS
    retry_wait: float = RETRY_WAIT_SECONDS

    def __post_init__(self) -> None:
        if self.source_lang not in SOURCE_LANGS:
            raise ValueError(f"source_lang {self.source_lang!r} is not one of {SOURCE_LANGS}")
        if self.target_lang not in TARGET_LANGS:
            raise ValueError(f"target_lang {self.target_lang!r} is not one of {TARGET_LANGS}")
        if not MIN_MAX_TOKENS <= self.max_tokens <= MAX_MAX_TOKENS:
            raise ValueError(f"max_tokens must be {MIN_MAX_TOKENS}..{MAX_MAX_TOKENS}")
        if self.json_mode not in JSON_MODES:
            raise ValueError(f"json_mode {self.json_mode!r} is not one of {JSON_MODES}")
        if self.max_attempts < 1:
            raise ValueError("max_attempts must be at least 1")

    @property
    def prompt_hash(self) -> str:
        """Identifies everything but the text that the model is given."""
        spoken = "\x1f".join((self.system_prompt, self.message_template, str(self.max_tokens)))
        return hashlib.sha256(spoken.encode()).hexdigest()[:16]

    @property
    def scope(self) -> str:
        """Two equal chunks of one scope have the same translation."""
        return "\x1f".join((self.source_lang, self.target_lang, self.prompt_hash, self.model))
