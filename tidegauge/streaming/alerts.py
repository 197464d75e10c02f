"""Fire-once alerts: one pure step over a ticker's state, used by a batch fold and by a stateful stream.

A state is a dict with seen, phase, stage, quadrant, flags and fired (key to date). Dimensions alert on change, flags on appearing. A key that
fired less than its cooldown of weekdays ago stays silent. A ticker's first row only seeds its state.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COOLDOWN, FLAG_COOLDOWN = 21, 5
VERSION = 1
#: Values that say that there is no value.
NOTHING = (None, 0, "", "Unknown")
HIGH_PHASES = ("CONFIRMED_BREAKOUT", "STEALTH_ACCUMULATION", "DISTRIBUTION", "CAPITAL_FLIGHT")
SCHEMA = "ticker string, session date, kind string, key string, value string, severity string"


def weekdays(a: date, b: date) -> int:
    """Weekdays from a up to but without b; negative if b is before a."""
    if b < a:
        return -weekdays(b, a)
    weeks, rest = divmod((b - a).days, 7)
    return 5 * weeks + sum((a.weekday() + i) % 7 < 5 for i in range(rest))


def weekdays_between(a, b):
    """The same as a column, in closed form: whole weeks, and the days left over."""
    days = F.date_diff(b, a)
    rest, start = days % 7, F.weekday(a)
    left = sum((F.when((rest > i) & ((start + i) % 7 < 5), 1).otherwise(0) for i in range(6)), F.lit(0))
    return F.floor(days / 7) * 5 + left


def step(state: dict | None, row: dict, cooldown: int = COOLDOWN, flag_cooldown: int = FLAG_COOLDOWN) -> tuple[dict, list[dict]]:
    """The state after a row (session, phase, stage, quadrant, flags: kinds), and what it fired."""
    today, dims = row["session"], ("phase", "stage", "quadrant")
    flags = list(row.get("flags") or [])
    new = {d: row.get(d) for d in dims} | {"flags": flags, "fired": dict((state or {}).get("fired") or {}), "version": VERSION}
    if not state or state.get("version") != VERSION:
        return new | {"fired": {}}, []
    fired, out = new["fired"], []

    def fire(key: str, kind: str, value, wait: int, severity: str) -> None:
        last = fired.get(key)
        if last is None or weekdays(date.fromisoformat(last), today) >= wait:
            fired[key] = today.isoformat()
            out.append({"session": today, "kind": kind, "key": key, "value": str(value), "severity": severity})

    for d in dims:
        was, now = state.get(d), new[d]
        if was is None or was == now or now in NOTHING:
            continue
        fire(f"{d}={now}", d, now, cooldown, "high" if now in HIGH_PHASES or (d == "stage" and now == 4) else "normal")
    for kind in flags:
        if kind not in (state.get("flags") or []):
            fire(f"flag:{kind}", "flag", kind, flag_cooldown, "high" if kind == "stage4" else "normal")
    new["fired"] = {k: v for k, v in fired.items() if weekdays(date.fromisoformat(v), today) <= 2 * max(cooldown, flag_cooldown)}
    return new, out


def fold(rows: Iterable[dict], state: dict | None = None, **how) -> tuple[dict | None, list[dict]]:
    out: list[dict] = []
    for r in sorted(rows, key=lambda r: r["session"]):
        state, fired = step(state, r, **how)
        out += fired
    return state, out


def _rows(pdf: pd.DataFrame) -> list[dict]:
    clean = lambda v: None if v is None or (not isinstance(v, (list, tuple)) and not hasattr(v, "tolist") and pd.isna(v)) else v
    return [{"session": r.session, "phase": clean(r.phase), "stage": clean(r.stage), "quadrant": clean(r.quadrant), "flags": list(r.flags) if r.flags is not None else []} for r in pdf.itertuples(index=False)]


def alerts(frame: DataFrame, **how) -> DataFrame:
    """All alerts that a history (ticker, session, phase, stage, quadrant, flags) fires; a ticker's history is one group."""

    def run(key, pdf):
        _, out = fold(_rows(pdf), **how)
        return pd.DataFrame([{"ticker": key[0], **o} for o in out], columns=["ticker", "session", "kind", "key", "value", "severity"])

    return frame.select("ticker", "session", "phase", "stage", "quadrant", "flags").groupBy("ticker").applyInPandas(run, SCHEMA)


def stream_alerts(stream: DataFrame, **how) -> DataFrame:
    """The streaming twin: state by ticker survives between batches, rows of one batch are taken in order of session."""

    def run(key, pdfs: Iterator[pd.DataFrame], state):
        have = json.loads(state.get[0]) if state.exists else None
        rows = [r for pdf in pdfs for r in _rows(pdf)]
        have, out = fold(rows, have, **how)
        state.update((json.dumps(have),))
        yield pd.DataFrame([{"ticker": key[0], **o} for o in out], columns=["ticker", "session", "kind", "key", "value", "severity"])

    return stream.select("ticker", "session", "phase", "stage", "quadrant", "flags").groupBy("ticker").applyInPandasWithState(run, SCHEMA, "state string", "append", "NoTimeout")


def load_state(text: str | None) -> dict | None:
    """A state that was written as JSON; one that is broken or of another version counts as none, so the ticker seeds anew."""
    try:
        s = json.loads(text or "")
    except ValueError:
        return None
    return s if isinstance(s, dict) and s.get("version") == VERSION else None


def next_weekday(d: date, n: int) -> date:
    while n:
        d += timedelta(days=1)
        n -= d.weekday() < 5
    return d
