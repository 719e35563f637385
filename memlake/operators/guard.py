"""What is checked before a remote model is asked or a record is written, where a corpus came from, and what calls cost."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.text import collapsed

# Patterns of what is never written, and of messages that only acknowledge.
SECRET = r"(?i)(sk-(or-v1|ant)-[\w-]{8,}|xox[bp]-[\w-]{8,}|ghp_\w{20,}|AIza[\w-]{20,}|sbp_\w{20,}|postgres(ql)?://[^\s:]+:[^\s@]+@|password\s*[:=])"
HEALTH = r"(?i)\b(symptom|symptoms|medication|medications|diagnos\w*|prescri\w*|doctor|physio\w*|therap(y|ist)|blood pressure|migraine|insomnia|anxiety|depress\w*|#cc-health)\b"
ACKNOWLEDGED = (
    r"(?i)^((ok(ay)?|k|yes|yep|yeah|no|nope|thanks?|thank you|ty|thx|sure|cool|nice|great|perfect|awesome|go( ahead| for it)?|do it|ship it|lgtm|sounds good|continue|proceed|next|done|y|n|👍|🙏|✅)[,.!\s]*){1,4}$"
)
#: Dollars for a million tokens that go in and come out, by size of model (fixed values).
PRICES: Mapping[str, tuple[float, float]] = {"small": (0.8, 4.0), "medium": (3.0, 15.0), "large": (15.0, 75.0)}


class EgressRefused(PermissionError):
    """A scope that may not leave the cluster."""


def allowed_scopes(setting: str) -> frozenset[str]:
    """Scopes of a comma-separated setting."""
    return frozenset(x.strip() for x in setting.split(",")) - {""}


def may_leave(allowed: Sequence[str], column: str = "project_scope") -> Column:
    """Rows whose scope may be sent to a remote model; a null scope never may."""
    return F.coalesce(F.col(column).isin(*allowed), F.lit(False)) if allowed else F.lit(False)


def check_egress(scope: str | None, allowed: frozenset[str]) -> None:
    if scope not in allowed:
        raise EgressRefused(f"scope {scope!r} may not be sent to a remote model")


def chosen_model(name: str, makers: Mapping[str, Callable[[], object]], remote: frozenset[str], scope: str | None, allowed: frozenset[str]) -> object:
    """The model of that name; for a remote one the scope is checked before its maker runs."""
    if name not in makers:
        raise ValueError(f"unknown model {name!r}; one of {', '.join(sorted(makers))}")
    if name in remote:
        check_egress(scope, allowed)
    return makers[name]()


def provenance(path: str, data: bytes, pinned_path: str, pinned_sha256: str) -> str:
    """'public-fixture' for the pinned file with the pinned bytes, else 'db-sample'; the pinned file with other bytes is an error."""
    if not (os.path.exists(path) and os.path.exists(pinned_path)) or os.path.realpath(path) != os.path.realpath(pinned_path):
        return "db-sample"
    found = hashlib.sha256(data).hexdigest()
    if found != pinned_sha256:
        raise ValueError(f"{path} has the hash {found}, not the pinned {pinned_sha256}")
    return "public-fixture"


def refusal(content: Column, topics: Column) -> Column:
    """'secret', 'health' or null: why a text must not be written. Secrets come first."""
    text = F.concat_ws(" ", content, F.concat_ws(" ", topics))
    return F.when(text.rlike(SECRET), F.lit("secret")).when(text.rlike(HEALTH), F.lit("health"))


def skip_reason(prompt: Column, tools: Column, forks: Column, cap: int, mode: str = "on", interactive: Column | None = None, job: Column | None = None) -> Column:
    """Why an exchange isn't looked at, the first reason that holds; null to go on."""
    flat = collapsed(F.regexp_replace(prompt, r"[\x00-\x08\x0b-\x1f\x7f]", ""))
    return (
        F.when(F.lit(mode == "off"), "off")
        .when(~(interactive if interactive is not None else F.lit(True)), "headless")
        .when(job if job is not None else F.lit(False), "scheduled-job")
        .when(flat == "", "no-prompt")
        .when(flat.rlike(ACKNOWLEDGED), "acknowledgement")
        .when((tools == 0) & (F.length(flat) < 200), "too-small")
        .when(forks >= cap, "cap")
    )


def token_price(size: str, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars for the tokens of a call at the list price."""
    into, out = PRICES[size]
    return tokens_in / 1_000_000 * into + tokens_out / 1_000_000 * out
