"""String functions: paths, joins, shell escaping, templates, printf formats, durations and times."""

from __future__ import annotations

import re
import time
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column, suffix: str | None = None) -> Column:
    """Last component, trailing slashes ignored; '/' stays '/'; a given suffix is cut unless it is all."""
    out = F.when(path.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_extract(path, "([^/]*)/*$", 1))
    if suffix:
        out = F.when(out.endswith(suffix) & (out != suffix), F.substr(out, F.lit(1), F.length(out) - len(suffix))).otherwise(out)
    return out


def dirname(path: Column) -> Column:
    """What precedes the last component; '.' without a slash, '/' at the root."""
    body = F.regexp_replace(path, "/+$", "")
    parent = F.regexp_replace(F.regexp_replace(body, "[^/]*$", ""), "(?<=.)/+$", "")
    return F.when(path.rlike("^/+$"), "/").when(~body.contains("/"), ".").when(parent == "", "/").otherwise(parent)


def join(items: Column, delimiter: str = " ") -> Column:
    return F.array_join(items, delimiter)


def shell_escape(text: Column) -> Column:
    r"""Double-quoted, with \ " $ and backtick escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'([\\"$`])', r"\\$1"), F.lit('"'))


_SPEC = re.compile(r"%(%|[-+ #0]*\d*(?:\.\d+)?[dieEfFgGs])")


def printf(template: str, *args: Column) -> Column:
    """C formats d i e E f F g G s and %%; g prints like C, without trailing zeros."""
    parts, at, left = [], 0, list(args)
    for m in _SPEC.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at, spec = m.end(), m[1]
        if spec == "%":
            parts.append(F.lit("%"))
            continue
        if not left:
            raise ValueError("format: too few arguments")
        value, kind = left.pop(0), spec[-1]
        if kind in "gG":
            parts.append(_general(value, spec))
        else:
            cast = {"d": "long", "i": "long", "s": "string"}.get(kind, "double")
            parts.append(F.format_string("%" + spec[:-1] + {"i": "d", "F": "f"}.get(kind, kind), value.cast(cast)))
    if left:
        raise ValueError("format: too many arguments")
    return F.concat(*parts, F.lit(template[at:]))


def _general(value: Column, spec: str) -> Column:
    """%g from JVM expressions: %e or %f by exponent, zeros stripped."""
    m = re.search(r"\.(\d+)", spec)
    digits = max(1, int(m[1]) if m else 6)
    v = value.cast("double")
    exact = F.format_string(f"%.{digits - 1}e", v)
    exponent = F.regexp_extract(exact, r"e([-+]\d+)$", 1).cast("int")
    mantissa = F.regexp_extract(exact, r"^(.*)e", 1)
    short = F.when(mantissa.contains("."), F.regexp_replace(mantissa, r"\.?0+$", "")).otherwise(mantissa)
    fixed = None
    for e in range(-4, digits):
        one = F.format_string(f"%.{max(digits - 1 - e, 0)}f", v)
        one = F.regexp_replace(one, r"\.?0+$", "") if digits - 1 - e > 0 else one
        fixed = F.when(exponent == e, one) if fixed is None else fixed.when(exponent == e, one)
    out = fixed.otherwise(F.concat(short, F.regexp_extract(exact, r"(e[-+]\d+)$", 1)))
    return F.upper(out) if spec[-1] == "G" else out


def template(text: str, **values: Column) -> Column:
    """{name} substitution; {{ and }} stand for braces; an unknown name is an error."""
    parts, at = [], 0
    for m in re.finditer(r"((?:[^{}]|\{\{|\}\})+)|\{(\w+)\}", text):
        if m.start() != at:
            break
        at = m.end()
        if m[2]:
            if m[2] not in values:
                raise ValueError(f"template: {m[2]} is not defined")
            parts.append(values[m[2]].cast("string"))
        else:
            parts.append(F.lit(m[1].replace("{{", "{").replace("}}", "}")))
    if at != len(text):
        raise ValueError(f"template: a single brace at {at}")
    return F.concat(*parts) if parts else F.lit("")


def fnmatch(text: Column, pattern: str) -> Column:
    """Shell wildcards over the whole string."""
    out, at = "", 0
    while at < len(pattern):
        c, end = pattern[at], pattern.find("]", at + (3 if pattern[at + 1 : at + 2] == "!" else 2))
        if c == "[" and end > 0:
            inside = pattern[at + 1 : end]
            negated = inside.startswith("!")
            inside = re.sub(r"([\\\[\]^&~])", r"\\\1", inside[negated:])
            out += f"[{'^' * negated}{inside}]"
            at = end + 1
            continue
        out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        at += 1
    return text.rlike(f"(?s)^(?:{out})$")


def duration(text: str) -> int:
    """Seconds of '5s', '3m', '2h', '1d'; plain numbers are seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhdSMHD]?)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2].lower()]


def epoch(text: str, now: float | None = None) -> int:
    """'now', '<n><unit>' ago (s m h d w y), or 'YYYY-MM-DD[ HH:MM:SS]' in UTC."""
    now = time.time() if now is None else now
    if text.strip() == "now":
        return int(now)
    if m := re.fullmatch(r"(\d+)\s*([smhdwyS MHDWY])", text.strip()):
        return int(now) - int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}[m[2].lower()]
    for shape in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return int(datetime.strptime(text.strip(), shape).replace(tzinfo=timezone.utc).timestamp())
        except ValueError:
            continue
    raise ValueError(f"not a time: {text!r}")


def byte_size(n: Column) -> Column:
    """1024-based with two decimals, halves to even as C prints them: 1536 -> '1.50 KB'."""
    power = F.when(n >= 1, F.least(F.floor(F.log2(n.cast("double")) / 10 + 1e-12), F.lit(5))).otherwise(0)
    unit = F.get(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB", "PB")]), power.cast("int"))
    return F.concat(F.format_string("%.2f", F.bround(n.cast("double") / F.pow(F.lit(1024.0), power), 2)), F.lit(" "), unit)
