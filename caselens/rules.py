"""Rule configuration: what a rule may say, checked when it is loaded."""

from __future__ import annotations

import json
import re
from pathlib import Path

from . import fixed_values
from .schema import CROSS_SOURCE_RULE_ID, RULE_FIELDS, SEVERITIES

# Rule vocabulary and hit budgets per scan.
TARGETS = ["web", "middleware", "audit", "any"]
MATCH_FIELDS = ["path", "query", "ua", "method", "status", "raw"]
METRICS = ["bytes", "status"]
ID_PATTERN = r"[a-z0-9]+(-[a-z0-9]+)*"
SIGNATURE_MAX_HITS = 500
STAT_MAX_HITS = 50
TIME_OPERATORS = ["rate_spike", "sequence", "periodicity"]
CROSS_SOURCE_RULE = {
    "id": CROSS_SOURCE_RULE_ID, "title": "Global entity seen in several sources",
    "severity": "high", "operator": "cross_source_entity"}

# operator → parameter → (kind, exclusive lower bound, default); no default = required.
_INT, _NUM = "integer", "number"
OPERATOR_PARAMETERS = {
    "same_key_divergence": {
        "key_fields": ("fields",), "diverge_field": ("field",), "metric": ("metric",),
        "min_group_events": (_INT, 1), "diverge_ratio": (_NUM, 1.0)},
    "cross_key_same_value": {
        "value_field": ("field",), "key_fields": ("fields",), "min_keys": (_INT, 1),
        "max_value_freq": (_INT, 1), "exclude_kb": ("exclusion", None, None)},
    "rate_spike": {
        "key_fields": ("fields",), "bucket_seconds": (_INT, 0), "zscore": (_NUM, 0.0),
        "min_bucket_count": (_INT, 0)},
    "size_outlier": {
        "key_fields": ("fields",), "metric": ("metric",), "min_group_events": (_INT, 1),
        "deviate_ratio": (_NUM, 1.0), "max_outliers": (_INT, 0, 3)},
    "sequence": {
        "key_fields": ("fields",), "steps": ("steps",), "window_seconds": (_INT, 0),
        "min_first_step_count": (_INT, 0, 3)},
    "periodicity": {
        "key_fields": ("fields",), "min_events": (_INT, 2, 6), "max_cv": (_NUM, 0.0, 0.2),
        "min_span_seconds": (_INT, 0, 300)},
}


class RuleError(ValueError):
    """A rule that must not run; the message lists every problem."""


def _is_number(value, kind: str) -> bool:
    allowed = int if kind == _INT else (int, float)
    return isinstance(value, allowed) and not isinstance(value, bool)


def _problem(name: str, kind: str, bound, value, exclusions: dict) -> str | None:
    """What is wrong with one parameter value, or None."""
    if kind in (_INT, _NUM):
        if not _is_number(value, kind):
            return f"{name} must be a {kind}"
        return None if value > bound else f"{name} must be above {bound}"
    if kind == "field":
        return None if value in RULE_FIELDS else f"{name} must be one of {RULE_FIELDS}"
    if kind == "metric":
        return None if value in METRICS else f"{name} must be one of {METRICS}"
    if kind == "fields":
        ok = isinstance(value, list) and value and all(v in RULE_FIELDS for v in value)
        return None if ok else f"{name} must be a non-empty list of {RULE_FIELDS}"
    if kind == "exclusion":
        return None if value in exclusions else f"{name}: no exclusion list {value!r}"
    if kind == "steps":
        if not isinstance(value, list) or len(value) not in (2, 3):
            return "steps must be a list of two or three steps"
        for step in value:
            if not isinstance(step, dict) or sorted(step) != ["field", "in"]:
                return "a step has exactly the keys field and in"
            constants = step["in"]
            if step["field"] not in RULE_FIELDS:
                return f"step field must be one of {RULE_FIELDS}"
            if not isinstance(constants, list) or not constants or not all(
                    isinstance(c, (str, int)) and not isinstance(c, bool) for c in constants):
                return "step in must be a non-empty list of constants"
        return None
    raise AssertionError(kind)


def _common_problems(rule, allowed: set[str], required: list[str]) -> list[str]:
    if not isinstance(rule, dict):
        raise RuleError("a rule is a mapping")
    problems = [f"unknown keys {sorted(set(rule) - allowed)}"] if set(rule) - allowed else []
    problems += [f"{name} missing" for name in required if name not in rule]
    if "id" in rule and not (isinstance(rule["id"], str)
                             and re.fullmatch(ID_PATTERN, rule["id"])):
        problems.append("id must be lower-case words joined by hyphens")
    if "title" in rule and not (isinstance(rule["title"], str) and rule["title"].strip()):
        problems.append("title must be non-empty text")
    if "severity" in rule and rule["severity"] not in SEVERITIES:
        problems.append(f"severity must be one of {SEVERITIES}")
    if "note" in rule and not isinstance(rule["note"], str):
        problems.append("note must be text")
    if "max_hits" in rule:
        problem = _problem("max_hits", _INT, 0, rule["max_hits"], {})
        problems += [problem] if problem else []
    return problems


def _finish(rule: dict, problems: list[str]) -> dict:
    if problems:
        raise RuleError(f"{rule.get('id', '?')}: " + "; ".join(problems))
    return rule


def validate_signature(rule) -> dict:
    allowed = {"id", "title", "severity", "target", "match", "note", "max_hits", "status"}
    problems = _common_problems(rule, allowed, ["id", "title", "severity", "target", "match"])
    if "target" in rule and rule["target"] not in TARGETS:
        problems.append(f"target must be one of {TARGETS}")
    match = rule.get("match", {})
    if "match" in rule and (not isinstance(match, dict) or not match):
        problems.append("match must be a non-empty mapping")
        match = {}
    for field, tokens in match.items():
        if field not in MATCH_FIELDS:
            problems.append(f"match.{field}: must be one of {MATCH_FIELDS}")
        elif not isinstance(tokens, list) or not tokens or not all(
                isinstance(t, str) and t for t in tokens):
            problems.append(f"match.{field} must be a non-empty list of text")
    _finish(rule, problems)
    return {**rule, "match": {f: [t.lower() for t in tokens] for f, tokens in match.items()}}


def validate_stat(rule, exclusions: dict | None = None) -> dict:
    exclusions = fixed_values.EXCLUSIONS if exclusions is None else exclusions
    base = {"id", "title", "operator", "severity", "note", "max_hits", "status"}
    every = base | {p for params in OPERATOR_PARAMETERS.values() for p in params}
    problems = _common_problems(rule, every, ["id", "title", "operator", "severity"])
    if rule.get("operator") not in OPERATOR_PARAMETERS:
        problems.append(f"operator must be one of {sorted(OPERATOR_PARAMETERS)}")
        _finish(rule, problems)
    out = {k: v for k, v in rule.items() if k in base}
    for name, (kind, *rest) in OPERATOR_PARAMETERS[rule["operator"]].items():
        if name not in rule:
            if len(rest) < 2:
                problems.append(f"{name} missing")
            else:
                out[name] = rest[1]
            continue
        problem = _problem(name, kind, rest[0] if rest else None, rule[name], exclusions)
        problems += [problem] if problem else []
        out[name] = rule[name]
    _finish(rule, problems)
    if out["operator"] == "sequence":
        out["steps"] = [{"field": s["field"], "in": sorted({str(v).lower() for v in s["in"]})}
                        for s in out["steps"]]
    return out


def unique_rules(rules: list[dict]) -> list[dict]:
    ids = [r["id"] for r in rules]
    twice = sorted({i for i in ids if ids.count(i) > 1})
    if twice:
        raise RuleError(f"duplicate rule ids {twice}")
    return rules


def builtin_rules() -> tuple[list[dict], list[dict]]:
    """The built-in signature and statistical rules."""
    signatures = [validate_signature(r) for r in fixed_values.SIGNATURE_RULES]
    stats = [validate_stat(r) for r in fixed_values.STAT_RULES]
    unique_rules(signatures + stats)
    return signatures, stats


def _read(path: Path):
    """A JSON or YAML file as Python values; other files are None."""
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    if path.suffix in (".yaml", ".yml"):
        import yaml  # optional dependency
        return yaml.safe_load(text)
    return None


def load_exclusions(folder: str) -> dict[str, list[str]]:
    """Exclusion lists of a folder: file name → lower-case tokens."""
    out = {}
    for path in sorted(Path(folder).iterdir()):
        value = _read(path)
        if value is None:
            continue
        tokens = value.get("tokens") if isinstance(value, dict) else None
        if not isinstance(tokens, list) or not tokens or not all(
                isinstance(t, str) and t.strip() for t in tokens):
            raise RuleError(f"{path.name}: tokens must be a non-empty list of text")
        out[path.stem] = [t.strip().lower() for t in tokens]
    return out


def load_explanations(path: str) -> dict[str, list[tuple[str, str]]]:
    """An explanation file with paths, uas (lists of match and text) and statuses."""
    value = _read(Path(path))
    problems, out = [], {"path": [], "ua": [], "status": []}
    if not isinstance(value, dict):
        raise RuleError("an explanation file is a mapping")
    for kind, section in (("path", "paths"), ("ua", "uas")):
        for entry in value.get(section) or []:
            if isinstance(entry, dict) and all(
                    isinstance(entry.get(k), str) and entry[k].strip() for k in ("match", "text")):
                out[kind].append((entry["match"].strip().lower(), entry["text"].strip()))
            else:
                problems.append(f"{section}: an entry needs match and text")
    for code, text in (value.get("statuses") or {}).items():
        if re.fullmatch(r"\d{3}", str(code)) and isinstance(text, str) and text.strip():
            out["status"].append((str(code), text.strip()))
        else:
            problems.append(f"statuses: bad entry {code!r}")
    if not problems and not any(out.values()):
        problems.append("no entry")
    if problems:
        raise RuleError("; ".join(problems))
    return out


def load_rules(folder: str, exclusions: dict | None = None) -> tuple[list[dict], list[dict]]:
    """Rules from a folder of YAML or JSON files; only those with status enable.

    A file with ``operator`` is a statistical rule, any other a signature rule. A broken
    enabled file stops the load.
    """
    signatures, stats = [], []
    for path in sorted(Path(folder).iterdir()):
        rule = _read(path)
        if not isinstance(rule, dict) or rule.get("status", "draft") != "enable":
            continue
        if "operator" in rule:
            stats.append(validate_stat(rule, exclusions))
        else:
            signatures.append(validate_signature(rule))
    unique_rules(signatures + stats)
    return signatures, stats


def draft_ids(folder: str) -> set[str]:
    """Ids of the rules in a folder that are not enabled."""
    rules = [_read(path) for path in sorted(Path(folder).iterdir())]
    return {r["id"] for r in rules if isinstance(r, dict) and "id" in r
            and r.get("status", "draft") != "enable"}


def select_rules(signatures: list[dict], stats: list[dict], rule_ids: list[str] | None,
                 drafts: set[str] = frozenset()) -> tuple[list[dict], list[dict], bool]:
    """The chosen subset and whether the cross-source step runs; unknown ids stop all, and so
    do ids of ``drafts``, rules that are not enabled."""
    if rule_ids is None:
        return signatures, stats, True
    wanted = set(rule_ids)
    runnable = {r["id"] for r in signatures + stats} | {CROSS_SOURCE_RULE_ID}
    unknown = sorted(wanted - runnable - drafts)
    if unknown:
        raise RuleError(f"unknown rule ids {unknown}")
    blocked = sorted(wanted - runnable)
    if blocked:
        raise RuleError(f"rules that are not enabled {blocked}")
    keep = lambda rules: [r for r in rules if r["id"] in wanted]
    return keep(signatures), keep(stats), CROSS_SOURCE_RULE_ID in wanted


def hit_cap(rule: dict) -> int:
    return rule.get("max_hits", STAT_MAX_HITS if "operator" in rule else SIGNATURE_MAX_HITS)


def rule_titles(signatures: list[dict], stats: list[dict]) -> dict[str, str]:
    return {r["id"]: r["title"] for r in [*signatures, *stats, CROSS_SOURCE_RULE]}
