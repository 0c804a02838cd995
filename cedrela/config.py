"""Parameters that a deployment sets; nothing about an employer is built in."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Settings:
    as_of: date = date(1998, 8, 2)
    notice_days: int = 30
    trial_months: int = 2
    max_trial_days: int = 60
    memo_threshold: int = 3
    employer_name: str = ""
    employer_tax_id: str = ""


DEFAULT = Settings()
