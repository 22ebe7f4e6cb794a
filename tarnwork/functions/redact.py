"""Secret shapes in text: masking, collecting literal values, positions, and a probe for what is left.

Masking is a chain of JVM expressions. Assignments are found by looking at every separator: a name that speaks of a
secret right before it, a value right after it. A name that only looks like one (`path`, `dispatch`) is passed over,
and as the search goes on behind its separator, an assignment inside its value is met like any other; there is no
nesting to descend into. Every shape has literal traces and is tried only on texts that hold one of them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.runtime import ship_active

MASK = "[REDACTED]"
#: Shorter values aren't masked where they stand alone.
LITERAL_CHARS = 8

# Words of a name that speak of a secret; `pat` counts apart from the words that contain it.
KEY_WORDS = ["SECRET", "TOKEN", "PASSWORD", "PASSWD", "PASSPHRASE", "API[_-]?KEY", "ACCESS[_-]?KEY", "PRIVATE[_-]?KEY", "CREDENTIAL", "SERVICE[_-]?ROLE", "ANON[_-]?KEY", "AUTH[_-]?KEY", "BEARER", "DSN", "APIKEY"]
PAT_WORDS = ["dispatch", "compat", "spatial", "patient", "pattern", "patch", "path"]
# Values that stand for a secret without being one, and how references to one begin.
PLACEHOLDERS = ["undefined", "password", "changeme", "change-me", "placeholder", "redacted", "required", "localhost", "example", "examples", "your-key", "your_key", "xxxxxxxx", "********"]
REFERENCES = r"(?i)^(?:[$%<{]|process\.env\b|os\.environ\b|env\.|secrets\.)"
# What an assigned value looks like.
VALUE = r"""(?:"[^"\n]{4,}"|'[^'\n]{4,}'|[^\s"'`,;)]{4,})"""


@dataclass(frozen=True)
class Shape:
    """A shape's name, pattern, replacement, the pattern's group that is the secret, and its traces."""

    name: str
    pattern: str
    to: str
    secret: int
    traces: tuple[str, ...]


# Shapes of secrets in the order in which they are masked, after named assignments.
SHAPES = [
    Shape("connection-string-password", r"(?i)\b([a-z][a-z0-9+.-]{2,15}://)([^\s:@/]{1,64}):([^\s@/]{1,256})@", r"$1$2:[REDACTED]@", 3, ("://",)),
    Shape("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", "[REDACTED-JWT]", 0, ("eyJ",)),
    Shape("supabase-key", r"\bsb[a-z]{0,12}_[A-Za-z0-9_-]{16,}", "[REDACTED-KEY]", 0, ("sb",)),
    Shape("github-fine-grained-pat", r"\bgithub_pat_[A-Za-z0-9_]{20,}", "[REDACTED-KEY]", 0, ("github_pat_",)),
    Shape("github-token", r"\bgh[pousr]_[A-Za-z0-9]{16,}", "[REDACTED-KEY]", 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Shape("openai-key", r"\bsk-[A-Za-z0-9_-]{20,}", "[REDACTED-KEY]", 0, ("sk-",)),
    Shape("stripe-key", r"\b[sruwp]k_(?:live|test)_[A-Za-z0-9]{16,}", "[REDACTED-KEY]", 0, ("k_live_", "k_test_")),
    Shape("google-api-key", r"\bAIza[A-Za-z0-9_-]{30,}", "[REDACTED-KEY]", 0, ("AIza",)),
    Shape("gitlab-pat", r"\bglpat-[A-Za-z0-9_-]{16,}", "[REDACTED-KEY]", 0, ("glpat-",)),
    Shape("npm-token", r"\bnpm_[A-Za-z0-9]{30,}", "[REDACTED-KEY]", 0, ("npm_",)),
    Shape("aws-access-key-id", r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED-KEY]", 0, ("AKIA",)),
    Shape("slack-token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}", "[REDACTED-KEY]", 0, ("xox",)),
    Shape("pem-private-key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED-PRIVATE-KEY]", 0, ("PRIVATE KEY-----",)),
    Shape("bearer-header", r"\b[Bb]earer\s+([A-Za-z0-9._~+/-]{16,}=*)", "Bearer [REDACTED]", 1, ("earer",)),
    Shape("basic-header", r"\b([Bb]asic)\s+([A-Za-z0-9+/]{12,}={0,2})", r"$1 [REDACTED]", 2, ("asic",)),
]
# What shows that a secret was left, none of them matching a mask; beside these the shapes named.
RESIDUE = [r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.", r"://[^\s:@/]{1,64}:(?!\[REDACTED)[^\s@/]{8,}@", r"\b[Bb]asic\s+(?!\[REDACTED)[A-Za-z0-9+/]{12,}={0,2}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"]
RESIDUE_SHAPES = ["supabase-key", "github-token", "github-fine-grained-pat", "stripe-key", "google-api-key", "gitlab-pat", "npm-token"]


def _inside(word: str) -> str:
    """Look-arounds that hold where `pat` is part of `word` written in one case after its first letter."""
    at = word.index("pat")
    forms = []
    for cased in (word.lower(), word.upper()):
        first, before, after = cased[0], cased[1:at], cased[max(at, 1) :]
        forms.append(f"(?<=(?i:{first}){before}){after}" if at else f"(?i:{first}){after}")
    return "|".join(forms)


def _no_lookalike() -> str:
    """`pat` outside every lookalike word. A word is taken whole: where it holds a shorter one (`dispatch`), only its
    own casing counts."""
    longer = {w: [v for v in PAT_WORDS if v != w and v.endswith(w)] for w in PAT_WORDS}
    parts = []
    for word in PAT_WORDS:
        guard = "".join(f"(?<!(?i:{v[: -len(word)]}))" for v in longer[word])
        parts.append(f"{guard}(?:{_inside(word)})")
    return f"(?=[Pp][Aa][Tt])(?!{'|'.join(parts)})..."


# At most places in a text no word begins: their first letters are looked at before the words.
_FIRST = "".join(sorted({c for w in KEY_WORDS for c in (w[0], w[0].lower())}))
_NAME = rf"[A-Za-z0-9_]*?(?=[{_FIRST}])(?:(?i:{'|'.join(KEY_WORDS)})|{_no_lookalike()})[A-Za-z0-9_]*+"
#: Group 1 is the name with its quotes and the separator, group 3 the value.
ASSIGNMENT = rf"""((["']?)(?<![A-Za-z0-9_]){_NAME}\2\s*[:=]\s*)({VALUE})"""
NAMED = "named-assignment"
_NAMED = Shape(NAMED, ASSIGNMENT, r"$1[REDACTED]", 3, (":", "="))


def _holds(text: Column, shape: Shape) -> Column:
    out = text.contains(shape.traces[0])
    for trace in shape.traces[1:]:
        out = out | text.contains(trace)
    return out


def _masker(shape: Shape) -> Callable[[Column], Column]:
    return lambda t: F.when(_holds(t, shape), F.regexp_replace(t, shape.pattern, shape.to)).otherwise(t)


def redact(text: Column, extra: list[tuple[str, str]] | None = None, literals: Column | None = None) -> Column:
    """`text` with every known secret shape masked, then the shapes of `extra` rules (pattern, replacement), then the
    values of the array `literals` wherever they stand. Null stays null."""
    out = text
    for shape in [_NAMED, *SHAPES]:
        # A lambda over one value, so that the text so far is one expression and not two.
        out = F.transform(F.array(out), _masker(shape))[0]
    for pattern, replacement in checked_rules(extra or []):
        out = F.regexp_replace(out, pattern, replacement)
    return out if literals is None else redact_literals(out, literals)


def checked_rules(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A machine's own rules, refused when too many, too long, not a pattern, or matching nothing at all."""
    if len(rules) > 100:
        raise ValueError("at most 100 rules")
    for pattern, _ in rules:
        if len(pattern) > 1000:
            raise ValueError("a rule has at most 1000 characters")
        if _matches_nothing(pattern):
            raise ValueError(f"a rule must not match an empty text: {pattern!r}")
    return rules


def _matches_nothing(pattern: str) -> bool:
    return any(not m.group() for m in re.compile(pattern).finditer("Probe text 1, with-words.\n"))


def load_rules(text: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Rules of a machine's JSON file (`{"rules": [{"name", "pattern", "flags", "to"}]}`) and what was wrong with the
    others. A file of more than 256 KiB or of another form gives no rules; of more than 100 rules the first 100 count."""
    if len(text.encode()) > 256 * 1024:
        return [], ["file too large"]
    try:
        stated = json.loads(text)["rules"]
    except (ValueError, TypeError, KeyError):
        return [], ["no object with rules"]
    if not isinstance(stated, list):
        return [], ["no object with rules"]
    rules, problems, names = [], [], set()
    if len(stated) > 100:
        problems.append(f"{len(stated)} rules; only the first 100 are loaded")
    for number, rule in enumerate(stated[:100], 1):
        fault = _fault(rule, names)
        if fault:
            problems.append(f"rule {number}: {fault}")
            continue
        names.add(rule["name"])
        flags = "".join(sorted(set(rule.get("flags") or "") - {"u"}))
        to = rule.get("to")
        rules.append(((f"(?{flags})" if flags else "") + rule["pattern"], re.sub(r"([\\$])", r"\\\1", f"[REDACTED:{rule['name']}]" if to is None else to)))
    return rules, problems


def _fault(rule: object, names: set[str]) -> str:
    if not isinstance(rule, dict):
        return "not an object"
    name, pattern, flags, to = (rule.get(k) for k in ("name", "pattern", "flags", "to"))
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,63}", name):
        return "bad name"
    if name in names:
        return "duplicate name"
    if not isinstance(pattern, str) or not 0 < len(pattern) <= 1000:
        return "bad pattern"
    if flags is not None and (not isinstance(flags, str) or set(flags) - set("imsu") or len(set(flags)) < len(flags)):
        return "bad flags"
    if to is not None and (not isinstance(to, str) or len(to) > 200):
        return "bad replacement"
    try:
        return "matches the empty text" if _matches_nothing(pattern) else ""
    except re.error:
        return "no pattern"


def secret_shapes(text: Column) -> Column:
    """Names of the shapes found in a text, in order."""
    found = [F.when(_holds(text, s) & text.rlike(s.pattern), s.name) for s in SHAPES]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def _worth(value: Column) -> Column:
    return (F.length(value) >= LITERAL_CHARS) & ~value.contains(MASK) & ~F.lower(value).isin(PLACEHOLDERS) & ~value.rlike(REFERENCES)


def secret_values(text: Column) -> Column:
    """Literal values worth masking elsewhere, longest first: the password and not the text around it; values under
    eight characters, placeholders and references (`$NAME`, `process.env.NAME`) aren't. Null gives an empty array."""
    found = [F.when(_holds(text, s), F.regexp_extract_all(text, F.lit(s.pattern), F.lit(s.secret))) for s in [_NAMED, *SHAPES]]
    flat = F.flatten(F.transform(F.array(*found), lambda a: F.coalesce(a, F.array().cast("array<string>"))))
    kept = F.array_distinct(F.filter(F.transform(flat, lambda v: F.trim(_unquoted(v))), _worth))
    ranked = F.array_sort(F.transform(kept, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    return F.transform(ranked, lambda x: x["v"])


def redact_literals(text: Column, values: Column) -> Column:
    """`text` with each of the values (an array, longest first) masked; values under eight characters don't count."""
    return F.aggregate(F.filter(values, lambda v: F.length(v) >= LITERAL_CHARS), text, lambda t, v: F.replace(t, v, F.lit(MASK)))


def looks_redacted(text: Column) -> Column:
    """Whether no shape of a secret is left in a text; true for null."""
    shapes = {s.name: s.pattern for s in SHAPES}
    left = F.lit(False)
    for pattern in [*RESIDUE, *(shapes[n] for n in RESIDUE_SHAPES)]:
        left = left | text.rlike(pattern)
    return ~F.coalesce(left, F.lit(False))


def find_in(text: str | None, shapes: list[Shape] | None = None) -> list[tuple[str, int]]:
    """Rule and character position of every secret in a text, never the secret itself, in the rules' order. A rule that
    can't be applied is a finding (`<rule>:error` at 0), so that a scan never passes without having looked."""
    found = []
    for shape in shapes or [_NAMED, *SHAPES]:
        if not text or not any(t in text for t in shape.traces):
            continue
        try:
            for m in re.finditer(shape.pattern, text):
                value = m[shape.secret].strip()
                if len(value) > 1 and value[0] in "\"'" and value[0] == value[-1] and shape.name == NAMED:
                    value = value[1:-1]
                if len(value) >= LITERAL_CHARS and MASK not in value and value.lower() not in PLACEHOLDERS and not re.search(REFERENCES, value):
                    found.append((shape.name, m.start()))
        except (re.error, IndexError):
            found.append((f"{shape.name}:error", 0))
    return found


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("position", T.IntegerType())])))
def _positions(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"rule": r, "position": p} for r, p in find_in(t)])


def secret_matches(text: Column) -> Column:
    """Array of `rule` and `position` of the secrets in a text. Only texts that may hold one leave the JVM."""
    ship_active()
    likely = F.coalesce(text.rlike(ASSIGNMENT), F.lit(False))
    for shape in SHAPES:
        likely = likely | F.coalesce(_holds(text, shape), F.lit(False))
    return F.when(likely, _positions(F.when(likely, text))).otherwise(F.array().cast("array<struct<rule:string,position:int>>"))
