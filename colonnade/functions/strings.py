"""String methods by name: function(column, *args) -> (Column, kind).

Built-in expressions wherever they agree with Python; ``python`` marks the few
that run as Arrow-batched UDFs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from colonnade.operators.elementwise import fail_if

L = F.lit
#: Fixed value: characters that Python's ``str.isspace`` accepts, as a Java class.
SPACE = r"[\s\x0B\x1C-\x1F\x85   -     　]"


def python(name: str, returns: str, kind):
    """A method that runs Python's own, batch by batch."""

    def build(c: Column, *args, **kwargs):
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else getattr(v, name)(*args, **kwargs))

        return F.pandas_udf(run, returns)(c), kind

    return build


def plain_or_python(c: Column, plain: Column, name: str, returns: str, kind):
    """``plain`` for ASCII values, else Python's own: ASCII values reach the Python workers as nulls."""
    ascii_ = c.rlike(r"^\p{ASCII}*\z")
    return F.when(ascii_, plain).otherwise(python(name, returns, kind)(F.when(~ascii_, c))[0]), kind


def _count(c, sub):
    if sub == "":
        return F.length(c).cast("long") + 1, int
    return ((F.length(c) - F.length(F.replace(c, L(sub), L("")))) / len(sub)).cast("long"), int


def _find(c, sub, start=None, end=None, last=False):
    if start is not None or end is not None:
        return python("rfind" if last else "find", "long", int)(c, sub, start or 0, *([] if end is None else [end]))
    if not last:
        return (F.locate(sub, c) - 1).cast("long"), int
    at = F.locate(sub[::-1], F.reverse(c))
    found = F.when(at > 0, F.length(c) - at - len(sub) + 1).otherwise(-1)
    return F.when(c.isNotNull(), found).cast("long"), int


def _index(c, sub, start=None, end=None, last=False):
    at, _ = _find(c, sub, start, end, last)
    return fail_if(at < 0, "substring not found", at), int


def _after(c, sep):
    at = F.locate(sep, c)
    return F.when(c.isNull(), L(None)).when(at > 0, F.substring(c, at + len(sep), F.length(c))).otherwise(L("")), str


def _before_last(c, sep):
    tail = F.length(F.substring_index(c, sep, -1))
    return F.when(c.isNull(), L(None)).when(F.locate(sep, c) > 0, F.left(c, F.length(c) - tail - len(sep))).otherwise(L("")), str


def _affix(c, affix, start, end, whole, name):
    if start is not None or end is not None:
        return python(name, "boolean", bool)(c, affix, start or 0, *([] if end is None else [end]))
    options = affix if isinstance(affix, tuple) else (affix,)
    out = L(False)
    for a in options:
        out = out | whole(c, a)
    return F.when(c.isNotNull(), out), bool


def _strip(c, chars, left, right):
    if chars is None:
        if left:
            c = F.regexp_replace(c, f"^{SPACE}+", "")
        if right:
            c = F.regexp_replace(c, f"{SPACE}+\\z", "")
        return c, str
    if chars == "":
        return c, str
    if left and right:
        return F.btrim(c, L(chars)), str
    return (F.ltrim(c, L(chars)) if left else F.rtrim(c, L(chars))), str


def _pad(c, width, fill, side):
    if len(fill) != 1:
        raise TypeError("the fill character must be exactly one character long")
    n = F.length(c)
    if side == "left":
        out = F.lpad(c, width, fill)
    elif side == "right":
        out = F.rpad(c, width, fill)
    else:
        # Of an odd margin the left side gets the larger half where the width is odd too.
        margin = L(width) - n
        lead = F.floor(margin / 2) + (margin.bitwiseAND(L(width)).bitwiseAND(L(1)))
        out = F.concat(F.repeat(L(fill), lead.cast("int")), c, F.repeat(L(fill), (margin - lead).cast("int")))
    return F.when(n >= width, c).otherwise(out), str


def _zfill(c, width):
    n = F.length(c)
    signed = c.rlike(r"^[+-]")
    plain = F.lpad(c, width, "0")
    with_sign = F.concat(F.left(c, L(1)), F.lpad(F.substring(c, L(2), n), max(width - 1, 0), "0"))
    return F.when(n >= width, c).when(signed, with_sign).otherwise(plain), str


def _partition(c, sep, last=False):
    if not sep:
        raise ValueError("empty separator")
    has = F.locate(sep, c) > 0
    if last:
        head, tail = _before_last(c, sep)[0], F.substring_index(c, sep, -1)
        parts = F.when(has, F.array(head, L(sep), tail)).otherwise(F.array(L(""), L(""), c))
    else:
        head, tail = F.substring_index(c, sep, 1), _after(c, sep)[0]
        parts = F.when(has, F.array(head, L(sep), tail)).otherwise(F.array(c, L(""), L("")))
    return F.when(c.isNotNull(), parts), list


def _quoted(text):
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _split(c, sep=None, maxsplit=-1):
    if maxsplit >= 0:
        return python("split", "array<string>", list)(c, sep, maxsplit)
    if sep is None:
        bare = _strip(c, None, True, True)[0]
        return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+")), list
    if sep == "":
        raise ValueError("empty separator")
    return F.split(c, _quoted(sep)), list


def _rsplit(c, sep=None, maxsplit=-1):
    return _split(c, sep) if maxsplit < 0 else python("rsplit", "array<string>", list)(c, sep, maxsplit)


def _splitlines(c, keepends=False):
    if keepends:
        return python("splitlines", "array<string>", list)(c, True)
    lines = F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, L(1), F.size(lines) - 1)).otherwise(lines)
    return F.when(c.isNotNull(), lines), list


def _replace(c, old, new, count=-1):
    if count >= 0 or old == "":
        return python("replace", "string", str)(c, old, new, count)
    return F.replace(c, L(old), L(new)), str


def _swapcase(c):
    return python("swapcase", "string", str)(c)


def _translate(c, table):
    pairs = {chr(k) if isinstance(k, int) else k: v for k, v in table.items()}
    pairs = {k: chr(v) if isinstance(v, int) else v for k, v in pairs.items()}
    if all(v is None or len(v) == 1 for v in pairs.values()):
        kept = {k: v for k, v in pairs.items() if v is not None}
        gone = [k for k, v in pairs.items() if v is None]
        return F.translate(c, "".join([*kept, *gone]), "".join(kept.values())), str
    return python("translate", "string", str)(c, table)


def _join(c, items):
    items = [str(x) for x in items]
    if not items:
        return F.when(c.isNotNull(), L("")), str
    out = L(items[0])
    for item in items[1:]:
        out = F.concat(out, c, L(item))
    return F.when(c.isNotNull(), out), str


METHODS = {
    "count": _count,
    "before": lambda c, sep: (F.substring_index(c, sep, 1), str),
    "after": _after,
    "before_last": _before_last,
    "after_last": lambda c, sep: (F.substring_index(c, sep, -1), str),
    "capitalize": lambda c: plain_or_python(
        c, F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, L(2), F.length(c)))), "capitalize", "string", str
    ),
    "casefold": python("casefold", "string", str),
    "center": lambda c, width, fillchar=" ": _pad(c, width, fillchar, "both"),
    "encode": lambda c, encoding="utf-8", errors="strict": (
        (F.encode(c, "UTF-8"), bytes) if encoding.lower() in ("utf-8", "utf8") else python("encode", "binary", bytes)(c, encoding, errors)
    ),
    "endswith": lambda c, suffix, start=None, end=None: _affix(c, suffix, start, end, lambda x, a: x.endswith(a), "endswith"),
    "expandtabs": python("expandtabs", "string", str),
    "find": _find,
    "format": python("format", "string", str),
    "format_map": python("format_map", "string", str),
    "index": _index,
    "isalnum": lambda c: (c.rlike(r"^[\p{L}\p{N}]+\z"), bool),
    "isalpha": lambda c: (c.rlike(r"^\p{L}+\z"), bool),
    "isascii": lambda c: (c.rlike(r"^\p{ASCII}*\z"), bool),
    "isdecimal": lambda c: (c.rlike(r"^\p{Nd}+\z"), bool),
    "isdigit": lambda c: plain_or_python(c, c.rlike(r"^[0-9]+\z"), "isdigit", "boolean", bool),
    "isidentifier": lambda c: plain_or_python(c, c.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"), "isidentifier", "boolean", bool),
    "islower": lambda c: ((c == F.lower(c)) & (c != F.upper(c)), bool),
    "isnumeric": lambda c: plain_or_python(c, c.rlike(r"^[0-9]+\z"), "isnumeric", "boolean", bool),
    "isprintable": lambda c: plain_or_python(c, c.rlike(r"^[\x20-\x7E]*\z"), "isprintable", "boolean", bool),
    "isspace": lambda c: (c.rlike(f"^{SPACE}+\\z"), bool),
    "istitle": python("istitle", "boolean", bool),
    "isupper": lambda c: ((c == F.upper(c)) & (c != F.lower(c)), bool),
    "join": _join,
    "ljust": lambda c, width, fillchar=" ": _pad(c, width, fillchar, "right"),
    "lower": lambda c: (F.lower(c), str),
    "lstrip": lambda c, chars=None: _strip(c, chars, True, False),
    "partition": _partition,
    "removeprefix": lambda c, p: (F.when(c.startswith(p), F.substring(c, L(len(p) + 1), F.length(c))).otherwise(c), str),
    "removesuffix": lambda c, s: (F.when(c.endswith(s), F.left(c, F.length(c) - len(s))).otherwise(c), str),
    "replace": _replace,
    "rfind": lambda c, sub, start=None, end=None: _find(c, sub, start, end, True),
    "rindex": lambda c, sub, start=None, end=None: _index(c, sub, start, end, True),
    "rjust": lambda c, width, fillchar=" ": _pad(c, width, fillchar, "left"),
    "rpartition": lambda c, sep: _partition(c, sep, True),
    "rsplit": _rsplit,
    "rstrip": lambda c, chars=None: _strip(c, chars, False, True),
    "split": _split,
    "splitlines": _splitlines,
    "startswith": lambda c, prefix, start=None, end=None: _affix(c, prefix, start, end, lambda x, a: x.startswith(a), "startswith"),
    "strip": lambda c, chars=None: _strip(c, chars, True, True),
    "swapcase": _swapcase,
    "title": python("title", "string", str),
    "translate": _translate,
    "upper": lambda c: (F.upper(c), str),
    "zfill": _zfill,
}
