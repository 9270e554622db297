"""Rules that users may change: YAML files over the fixed values of constants."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import constants as C
from .sources.files import deep_merge

KINDS = ("cleaning", "preserved", "relation_phrases", "acronyms", "gazetteer", "prompts", "settings")


@dataclass
class Rules:
    """What cleaning, extraction and resolution take; malformed entries are left out and named in `skipped`."""

    cleaning: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(C.CLEANING))
    preserved: tuple[str, ...] = C.PRESERVED[:5]
    relation_phrases: tuple[tuple[str, str, bool], ...] = C.RELATION_PHRASES
    acronyms: dict[str, str] = field(default_factory=lambda: dict(C.ACRONYM_OVERRIDES))
    gazetteer: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(C.GAZETTEER))
    prompts: dict[str, str] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)


def load(path: str, env: dict | None = None) -> Rules:
    """Rules of a YAML file; what it doesn't name stays as it is. `env` settings beat those of the file.

    cleaning: category -> patterns. relation_phrases: list of {type, phrase, swapped}.
    acronyms: acronym -> expansion, or a list whose first is meant. gazetteer: type -> terms.
    """
    import yaml

    with open(path, encoding="utf-8") as f:
        told = yaml.safe_load(f) or {}
    out = Rules()
    out.skipped += [k for k in told if k not in KINDS]
    for category, patterns in _map(told, "cleaning", out).items():
        out.cleaning[category] = tuple(p for p in _list(patterns) if _regex(p, f"cleaning.{category}", out))
    if "preserved" in told:
        out.preserved = tuple(p for p in _list(told["preserved"]) if _regex(p, "preserved", out))
    if "relation_phrases" in told:
        good = [r for r in _list(told["relation_phrases"]) if isinstance(r, dict) and r.get("type") and r.get("phrase") and _regex(r["phrase"], "relation_phrases", out)]
        out.skipped += ["relation_phrases"] * (len(_list(told["relation_phrases"])) - len(good))
        out.relation_phrases = tuple((str(r["type"]).upper(), r["phrase"], bool(r.get("swapped", False))) for r in good)
    for acronym, long in _map(told, "acronyms", out).items():
        first = next((str(x).strip() for x in _list(long) if x and str(x).strip()), "")
        if first:
            out.acronyms[str(acronym).strip().upper()] = first
        else:
            out.skipped.append(f"acronyms.{acronym}")
    for kind, terms in _map(told, "gazetteer", out).items():
        out.gazetteer[str(kind).upper()] = tuple(str(t).lower() for t in _list(terms))
    out.prompts |= {k: str(v) for k, v in _map(told, "prompts", out).items()}
    out.settings = deep_merge(_map(told, "settings", out), env or {})
    return out


def dump_acronyms(pairs: dict[str, list[str]], path: str) -> None:
    """Acronym -> expansions as YAML that load() reads."""
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({"acronyms": {k: sorted(v) for k, v in sorted(pairs.items())}}, f, allow_unicode=True)


def _map(told: dict, name: str, out: Rules) -> dict:
    value = told.get(name) or {}
    if not isinstance(value, dict):
        out.skipped.append(name)
        return {}
    return value


def _list(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _regex(pattern, where: str, out: Rules) -> bool:
    try:
        re.compile(pattern)
    except (re.error, TypeError):
        out.skipped.append(where)
        return False
    return True
