"""Risk memos from the few rows of one stress test's results, and summaries held to what the rows say."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dollars(x: float) -> str:
    size, sign = abs(x), "-" if x < 0 else ""
    return f"{sign}${size / 1e9:.1f}bn" if size >= 1e9 else f"{sign}${size / 1e6:.1f}m" if size >= 1e6 else f"{sign}${size:,.0f}"


def facts(totals: DataFrame, scenario_id: str) -> dict:
    """The one row of a scenario's totals, as a dictionary."""
    row = totals.where(totals["scenario_id"] == scenario_id).first()
    if row is None:
        raise LookupError(f"no scenario {scenario_id}")
    return row.asDict()


def summary(f: dict) -> str:
    """Three plain sentences."""
    loses = "loses" if f["pnl"] < 0 else "gains"
    breach = "falls below the requirement" if f["breach"] else "stays above the requirement"
    return f"Under {f['scenario_id']} the book of {f['positions']} positions {loses} {dollars(abs(f['pnl']))}. The capital ratio becomes {f['cet1_after'] * 100:.1f}% and {breach}. {f['downgraded']} obligors are downgraded."


def faults(draft: str, f: dict, most_words: int = 120) -> list[str]:
    """What is wrong with a draft: its length, marks of a template, advice or certainty, and every number that the facts don't have."""
    found = []
    if not draft.strip():
        found.append("empty")
    if len(draft.split()) > most_words:
        found.append("too long")
    if re.search(r"[{}\[\]<>]|\bTBD\b", draft):
        found.append("placeholder")
    if re.search(r"\b(should (buy|sell)|we recommend|guarantee[ds]?|will certainly|as an? (assistant|language model))\b", draft, re.IGNORECASE):
        found.append("advice or certainty")
    known = set(re.findall(r"\d[\d.,]*\d|\d", summary(f)))
    found += [f"unknown number {n}" for n in re.findall(r"\d[\d.,]*\d|\d", draft) if n not in known]
    return found


#: Placeholders that a draft may have, and those it must have.
SLOTS = ("SCENARIO", "POSITIONS", "RESULT", "RATIO", "REQUIREMENT", "DOWNGRADES")
NEEDED = ("RESULT", "RATIO")
#: Numbers in words, and what a draft with placeholders must not say: the scenario as a fact, harm that is done, claims put into reports' mouths, itself.
NUMBER_WORDS = r"\b(two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|hundreds?|thousands?|millions?|billions?|half|twice|doubled?)\b"
SAID = {
    "realised": r"\b(the (book|bank) (has )?lost|losses (have|had) (been|occurred)|suffered (a loss|losses))\b",
    "already hit": r"\b((bank|borrowers?|obligors?) (has|have) (already )?been (hit|affected|damaged)|already (hit|suffering))\b",
    "claims of reports": r"\breports? (say|says|claim|claims|suggest|suggests|confirm|confirms)\b",
    "about itself": r"\b(this (draft|summary|paragraph|text)|as requested|the placeholders?|rewritten)\b",
    "compared with itself": r"\babove \[RATIO\]",
}
BELOW, ABOVE, RISES = r"\b(falls?|drops?|dips?) (to )?below\b|\bbreach(es|ed)?\b", r"\b(stays?|remains?|holds?) above\b", r"\bratio (rises?|improves?|increases?|strengthens?)\b"


def problems(draft: Column, breach: Column, falls: Column) -> Column:
    """What is wrong with a draft that has placeholders in brackets where figures go, as an array of names, in a fixed order; none for a good one.

    breach says that the ratio falls below the requirement, falls that it falls at all.  A null draft is an empty one.
    """
    text = F.coalesce(draft, F.lit(""))
    slots = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([A-Z_]+)\]"), F.lit(1)))
    plain = F.regexp_replace(text, r"\[[A-Z_]+\]", " ")
    has = lambda pattern, where=text: where.rlike("(?i)" + pattern)
    checks = {
        "empty": F.trim(text) == "", "unknown placeholder": F.size(F.array_except(slots, F.array(*map(F.lit, SLOTS)))) > 0, "own numbers": plain.rlike("[0-9]") | has(NUMBER_WORDS, plain),
        "missing placeholder": F.size(F.array_except(F.array(*map(F.lit, NEEDED)), slots)) > 0, "breach denied": breach & has(ABOVE), "breach invented": ~breach & has(BELOW), "ratio rises": falls & has(RISES),
        **{name: has(pattern) for name, pattern in SAID.items()}, "unfinished": (F.trim(text) != "") & ~F.trim(text).rlike(r"[.!?][\"')]*$"),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))


def filled(draft: Column, values: dict[str, Column]) -> Column:
    """The draft with placeholders replaced: a sign that value and draft both have stays once, an article follows the value's sound, and a value that begins a sentence begins in upper case."""
    out = F.coalesce(draft, F.lit(""))
    for name, value in values.items():
        value, slot = F.coalesce(value.cast("string"), F.lit("")), f"[{name}]"
        out = F.when(value.startswith("$"), F.replace(out, F.lit(f"${slot}"), F.lit(slot))).otherwise(out)
        out = F.when(value.endswith("%"), F.replace(out, F.lit(f"{slot}%"), F.lit(slot))).otherwise(out)
        vowel = value.rlike(r"(?i)^[aeiou]|^8|^11|^18")
        for big, small in (("A", "an"), ("a", "an")):
            right = F.when(vowel, F.lit(f"{big}n {slot}")).otherwise(F.lit(f"{big} {slot}"))
            out = F.regexp_replace(out, F.lit(rf"\b{big}n? \[{name}\]"), right)
        begin = F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, 2, 1 << 20))
        out = F.regexp_replace(out, F.lit(rf"(^|[.!?]\s+)\[{name}\]"), F.concat(F.lit("$1"), _quoted(begin)))
        out = F.replace(out, F.lit(slot), value)
    return out


def _quoted(value: Column) -> Column:
    """A value as a replacement that means itself."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def checked_summary(f: dict, generate: Callable[[str], str] | None = None, tries: int = 2) -> str:
    """A generated draft if one passes the checks, or else the plain sentences."""
    for _ in range(tries if generate else 0):
        draft = generate(summary(f))
        if not faults(draft, f):
            return draft.strip()
    return summary(f)


def actions(f: dict) -> list[str]:
    """What to look at, by rule."""
    out = []
    if f["breach"]:
        out.append("Prepare capital measures: the ratio falls below the requirement.")
    if f["downgraded"]:
        out.append(f"Review the {f['downgraded']} downgraded obligors.")
    worst = min((k for k in f if k.startswith("pnl_")), key=lambda k: f[k])
    if f[worst] < 0:
        out.append(f"Check hedges of {worst[4:]}: it loses {dollars(-f[worst])}.")
    return out


def memo(totals: DataFrame, losses: DataFrame, scenario_id: str, generate: Callable[[str], str] | None = None) -> str:
    """A memo in HTML; every text is escaped.  losses is a top list, all of which is shown: cut it before to the length wanted."""
    f = facts(totals, scenario_id)
    rows = losses.where(losses["scenario_id"] == scenario_id).collect()
    cells = "".join(f"<tr><td>{html.escape(str(r['position_id']))}</td><td>{dollars(r['pnl'])}</td></tr>" for r in rows)
    steps = "".join(f"<li>{html.escape(a)}</li>" for a in actions(f))
    return f"<h1>{html.escape(scenario_id)}</h1><p>{html.escape(checked_summary(f, generate))}</p><ul>{steps}</ul><table>{cells}</table>"
