"""The head of a compiled document: flat keys with text or list values between two lines of three dashes."""

from __future__ import annotations

import re

PLAIN = re.compile(r"^[A-Za-z0-9_./][\w ./@+-]*$")
RESERVED = {"true", "false", "null", "yes", "no", "~"}


def quoted(value: object) -> str:
    text = str(value)
    if PLAIN.match(text) and text == text.strip() and text.lower() not in RESERVED and not re.fullmatch(r"[\d.]+", text):
        return text
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def unquoted(text: str) -> str:
    text = text.strip()
    if len(text) < 2 or text[0] != '"' or text[-1] != '"':
        return text
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text[1:-1])


def emit(head: dict[str, str | list[str]], body: str) -> str:
    lines = ["---"]
    for key, value in head.items():
        if isinstance(value, list):
            lines += [f"{key}:", *(f"  - {quoted(v)}" for v in value)] if value else [f"{key}: []"]
        else:
            lines.append(f"{key}: {quoted(value)}")
    return "\n".join([*lines, "---", "", body])


def parse(document: str) -> tuple[dict[str, str | list[str]], str]:
    """(head, body); a document without a head has an empty one."""
    lines = document.split("\n")
    if lines[0].strip() != "---" or "---" not in [x.strip() for x in lines[1:]]:
        return {}, document
    end = next(i for i, x in enumerate(lines[1:], 1) if x.strip() == "---")
    head: dict[str, str | list[str]] = {}
    last = ""
    for line in lines[1:end]:
        if line.startswith("  - ") and last:
            values = head[last]
            head[last] = [*(values if isinstance(values, list) else []), unquoted(line[4:])]
        elif ":" in line:
            last, _, value = line.partition(":")
            head[last] = [] if value.strip() in ("", "[]") else unquoted(value)
    body = "\n".join(lines[end + 1 :])
    return head, body.removeprefix("\n")
