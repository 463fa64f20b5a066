"""Small functions over names, values and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of key names that mark a secret.
SECRET_KEYS = [
    "password", "token", "secret", "apikey", "api_key", "authorization", "cookie", "credential", "privatekey", "private_key", "accesskey",
    "clientsecret",
]
# Words of a question that name no symbol.
STOP_WORDS = [
    "who", "what", "where", "when", "how", "why", "does", "do", "the", "a", "an", "of", "to", "in", "is", "are", "this", "that", "which", "please",
    "show", "find", "me", "calls", "call", "calling", "callers", "callee", "callees", "imports", "import", "uses", "use", "using",
]
SEVERITIES = ("low", "medium", "high", "critical")


def token_estimate(text: Column) -> Column:
    """Tokens by the rule of four bytes each; null is none."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def is_secret(key: Column, value: Column) -> Column:
    """A key that names a secret, or a url with user information."""
    k = F.lower(F.coalesce(key, F.lit("")))
    named = k.rlike("|".join(SECRET_KEYS))
    return named | F.coalesce(F.contains(value, F.lit("://")) & F.contains(value, F.lit("@")), F.lit(False))


def redacted(key: Column, value: Column) -> Column:
    return F.when(is_secret(key, value), F.lit("[redacted]")).otherwise(value)


def severity_rank(severity: Column) -> Column:
    """0 for low to 3 for critical, null for others."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def at_least(severity: Column, floor: str) -> Column:
    return severity_rank(severity) >= SEVERITIES.index(floor)


def percent_change(before: Column, after: Column) -> Column:
    """Change in percent; null from zero, of which no percentage can be taken."""
    return F.when(before != 0, (after - before) / before * 100)


def verdict(delta: Column, percent: Column, flat_percent: float, lower_is_better: bool = True) -> Column:
    """improved, regressed or flat: no change, or one within flat_percent."""
    better = delta < 0 if lower_is_better else delta > 0
    return F.when((delta == 0) | (F.coalesce(F.abs(percent), F.lit(float("inf"))) <= flat_percent), "flat").when(better, "improved").otherwise("regressed")


def name_parts(name: Column) -> Column:
    """The lower-cased parts of an identifier, cut at marks and before capitals."""
    cut = F.regexp_replace(name, "([A-Z])", " $1")
    return F.filter(F.split(F.lower(F.regexp_replace(cut, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def question_tokens(question: str) -> list[str]:
    """What a question may name: its words and their parts, without stop words, two letters at least."""
    import re

    found = set()
    for word in re.findall(r"[A-Za-z0-9_]+", question):
        parts = [p for p in re.split(r"[_\-]|(?<=.)(?=[A-Z])", word) if p]
        found |= {p.lower() for p in [word, *parts]}
    return sorted(t for t in found if len(t) >= 2 and t not in STOP_WORDS)


def _names(text: Column, token: str) -> Column:
    """Whether an identifier holds token as a whole part."""
    t = F.lower(text)
    return F.contains(t, F.lit(token)) & F.array_contains(F.split(t, "[^a-z0-9]+"), token)


def question_score(tokens: list[str], label: Column, id_: Column, path: Column, kind: Column) -> Column:
    """Sum over tokens of the best fit: 100 the label itself, 40 a part of it, 20 of the id, 15 in the path, 5 in the kind."""
    score = F.lit(0)
    for t in tokens:
        score = score + F.coalesce(
            F.when(F.lower(label) == t, 100).when(_names(label, t), 40).when(_names(id_, t), 20).when(F.contains(F.lower(path), F.lit(t)), 15).when(F.contains(F.lower(kind), F.lit(t)), 5),
            F.lit(0),
        )
    return score
