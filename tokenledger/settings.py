"""Settings with their defaults, and the price and credit books."""

from __future__ import annotations

from dataclasses import dataclass, field

# USD per million tokens, input and output, in order.
PRICES = (
    ("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 2.5, 10), ("gpt-4.1-mini", 0.4, 1.6), ("gpt-4.1", 2, 8), ("o4-mini", 1.1, 4.4), ("o3", 2, 8),
    ("gpt-5-mini", 0.25, 2), ("gpt-5", 1.25, 10), ("claude-3-haiku", 0.25, 1.25), ("haiku", 0.8, 4), ("claude-3-5-sonnet", 3, 15), ("sonnet", 3, 15),
    ("opus", 15, 75), ("gemini-1.5-flash", 0.075, 0.3), ("flash", 0.15, 0.6), ("gemini-1.5-pro", 1.25, 5), ("gemini", 1.25, 5),
)
# Credits a request, in order.
CREDITS = (
    ("gpt-4o-mini", 0), ("gpt-4.1", 0), ("gpt-4o", 1), ("o4-mini", 1), ("o3", 1), ("gpt-5-mini", 1), ("gpt-5", 1), ("haiku", 1),
    ("claude-3-5-sonnet", 1), ("sonnet", 1), ("opus", 10), ("gemini-1.5-flash", 0), ("flash", 0.25), ("gemini", 1),
)
# Whole words of hard and of trivial prompts, of generative ones and of those that bound the answer.
HARD = r"architect|design|debug|root cause|why does|vulnerab|security|prove|optimi[sz]e|concurren|race condition|trade-?off|refactor the|complex|algorithm|reason about|analy[sz]e deeply"
TRIVIAL = r"format|reformat|rename|typo|comment|indent|lint|prettify|boilerplate|stub|getter|setter|import|spelling|count|list|find|how many|show|read|check|summari[sz]e"
GENERATIVE = r"write|generate|create|implement|draft|explain|produce|build|refactor|document"
BRIEF = r"brief|concise|short|only|just|no explanation|diff only|patch only|bullet"
STABLE_LEAD = r"you are|your task|instructions?:|role:|context:"


@dataclass(frozen=True)
class Settings:
    session_budget: int = 50_000
    daily_budget: int = 500_000
    warn_pct: int = 80
    hard_block: bool = False
    max_refs: int = 5
    snowball_tokens: int = 4_000
    cheap_hints: tuple = ("mini", "haiku", "flash", "small", "lite", "nano", "4o-mini", "3.5")
    sensitive_patterns: tuple = ()
    reasoning_hints: tuple = ("opus", "o1", "o3", "o4", "gpt-5", "reason", "think")
    price_overrides: dict = field(default_factory=dict)
    credit_overrides: dict = field(default_factory=dict)
    fallback: tuple = (2.0, 8.0)
    assumed_cache_fraction: float = 0.0
    cache_read_multiplier: float = 0.1
    reasoning_multiplier: float = 2.5
    max_tool_result_chars: int = 8_000
    block_duplicates: bool = True
    dup_threshold: float = 0.85
    history_threshold: float = 0.7
    enable_compaction: bool = True
    max_context_tokens: int = 24_000
    max_tools: int = 64
    min_turns: int = 8
    suggestion_floor: float = 0.4
    #: Of days; the session's where it is None.
    timezone: str | None = None

    def prices(self) -> list[tuple[int, str, float, float]]:
        """The price book in order: an override takes its key's place, new keys follow."""
        book = {k: (a, b) for k, a, b in PRICES} | dict(self.price_overrides)
        return [(i, k, float(a), float(b)) for i, (k, (a, b)) in enumerate(book.items())]

    def credits(self) -> list[tuple[int, str, float]]:
        book = dict(CREDITS) | dict(self.credit_overrides)
        return [(i, k, float(v)) for i, (k, v) in enumerate(book.items())]


DEFAULTS = Settings()
