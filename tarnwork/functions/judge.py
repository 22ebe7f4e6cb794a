"""A judge of prompts behind a protocol, with a budget; only a deterministic one for tests ships."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol


class Judge(Protocol):
    """Answers a prompt with an object that a schema describes, and says what it cost."""

    def judge(self, prompt: str, schema: dict[str, Any]) -> tuple[dict[str, Any], int]: ...


class FixedJudge:
    """Answers by a function of the prompt, at one token per four characters."""

    def __init__(self, answer: Callable[[str], dict[str, Any]]) -> None:
        self.answer = answer

    def judge(self, prompt: str, schema: dict[str, Any]) -> tuple[dict[str, Any], int]:
        out = self.answer(prompt)
        missing = [k for k in schema.get("required", []) if k not in out]
        if missing:
            raise ValueError(f"answer lacks {missing}")
        return out, len(prompt) // 4


@dataclass
class Spend:
    """What a run may still use; it stops at its limits or after failures in a row."""

    calls: int = 100
    tokens: int = 200_000
    failures: int = 2
    used_calls: int = 0
    used_tokens: int = 0
    failed_in_row: int = 0

    def allows(self, estimate: int) -> bool:
        return self.used_calls < self.calls and self.used_tokens + estimate <= self.tokens and self.failed_in_row < self.failures

    def ask(self, judge: Judge, prompt: str, schema: dict[str, Any]) -> dict[str, Any] | None:
        """An answer, or None when the budget is spent or the judge failed."""
        if not self.allows(len(prompt) // 4):
            return None
        self.used_calls += 1
        try:
            out, cost = judge.judge(prompt, schema)
        except Exception:  # any failure of a judge counts, none ends the run
            self.failed_in_row += 1
            return None
        self.failed_in_row, self.used_tokens = 0, self.used_tokens + cost
        return out

    def exit_code(self, findings: int = 0) -> int:
        """0 done, 1 findings, 3 stopped by the budget or failures."""
        return 3 if not self.allows(0) else 1 if findings else 0
