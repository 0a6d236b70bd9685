"""Column helpers for text: patterns, byte offsets, numbers at the start of a text, paths and dates."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "0-9A-Za-z_"


def pattern(text: str, literal: bool = False, ignore_case: bool = False, word: bool = False, multiline: bool = False) -> str:
    """A Java pattern of a search. Line ends are line feeds alone; word boundaries are those of ASCII words; multiline, for
    whole texts, lets . match line ends and ^ and $ match at them, and is ignored for literal texts. A pattern that the JVM
    can't compile raises ValueError."""
    out = re.sub(r"([^0-9A-Za-z_\s])", r"\\\1", text) if literal else text
    if word:
        out = f"(?<![{WORD}])(?:{out})(?![{WORD}])"
    flags = ("d" if not literal and re.search(r"[.^$\\]", text.replace("\\p", "")) else "") + ("i" if ignore_case else "") + ("ms" if multiline and not literal else "")
    out = f"(?{flags}){out}" if flags else out
    jvm = SparkContext._jvm
    if jvm is not None:
        try:
            jvm.java.util.regex.Pattern.compile(out)
        except (Py4JJavaError, PySparkException) as e:
            raise ValueError(f"bad pattern {text!r}: {e}") from None
    return out


def required_word(regex: str) -> str | None:
    """The longest run of ASCII letters, digits and blanks that every match of a pattern of ``pattern`` holds, or None where
    none is sure: in patterns of any case, with flags of their own, or beyond what both dialects read alike."""
    body = re.sub(r"^\(\?[dms]+\)", "", regex)
    if re.search(r"\(\?[a-zA-Z-]*[a-zA-Z][:)]|\\[^.\[\](){}*+?^$|\\/\-dDwWsSbBAnrt]", body):
        return None
    try:
        parsed = re._parser.parse(body)
    except (re.error, OverflowError):
        return None
    best, now = "", ""

    def walk(items) -> None:
        nonlocal best, now
        for op, arg in items:
            name = str(op)
            if name == "LITERAL" and chr(arg).isascii() and (chr(arg).isalnum() or arg == 32):
                now += chr(arg)
                best = max(best, now, key=len)
                continue
            if name == "SUBPATTERN" and not arg[1] and not arg[2]:
                walk(arg[3])
                continue
            now = ""
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                walk(arg[2])
                now = ""

    walk(parsed)
    return best or None


def replacement(text: str, literal: bool = False) -> str:
    """A Java replacement: groups as $1, or the text as it stands."""
    return re.sub(r"([\\$])", r"\\\1", text) if literal else text


def glob(pattern: str) -> str:
    """A Java pattern of whole paths for a glob: * and ? stop at slashes, ** doesn't, [ab] and {a,b} are choices; a glob
    without a slash fits the last part of a path."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            own = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = f"{out}[{'^' + own[1:] if own[0] == '!' else own}]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.sub(r"([^0-9A-Za-z_/])", r"\\\1", c)
        i += 1
    return f"^{'' if '/' in pattern else '(?:.*/)?'}{out}$"


def first_match(text: Column, regex: str) -> Column:
    """The first match, or an empty string."""
    return F.regexp_extract(text, regex, 0)


def byte_start(text: Column, regex: str) -> Column:
    """Bytes before the first match, found in the whole text, so that lookaround and flags hold; all bytes without one."""
    return F.octet_length(F.split(text, regex, 2)[0])


def leading_int(text: Column) -> Column:
    """The integer that a text begins with, null if it begins with none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def leading_number(text: Column) -> Column:
    """The number that a text begins with, null if it begins with none."""
    return F.regexp_extract(text, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double")


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves upwards, as x + 1/2 rounded down."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/?$", 1)


def clean_path(path: Column) -> Column:
    """Slashes for backslashes, no empty or . parts, each .. taken together with the part before it (one at the beginning of
    an absolute path falls away, of a relative one stays); . for nothing."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    rooted = F.translate(path, "\\", "/").startswith("/")

    def step(a: Column, x: Column) -> Column:
        size, up = F.size(a), x == ".."
        inside = (size > 0) & (F.get(a, size - 1) != "..")
        return F.when(up & inside, F.slice(a, F.lit(1), F.greatest(size - 1, F.lit(0)))).when(up & rooted, a).otherwise(F.array_append(a, x))

    kept = F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), kept)).when(kept == "", ".").otherwise(kept)


def bare_mail(text: Column) -> Column:
    """An address without the angle brackets around it."""
    return F.regexp_replace(text, "^<|>$", "")


def relative_date(then: Column, now: Column) -> Column:
    """How long ago a Unix time was, in words; ``now`` is a parameter, so that results can be repeated."""
    s = now - then
    out = F.lit("just now")
    # Seconds of a unit and its name; a unit serves up to where the next one begins.
    for least, unit, name in ((60, 60, "minutes"), (3600, 3600, "hours"), (86400, 86400, "days"), (7 * 86400, 7 * 86400, "weeks"), (30 * 86400, 30 * 86400, "months"), (365 * 86400, 365 * 86400, "years")):
        out = F.when(s >= least, F.concat(F.floor(s / unit).cast("string"), F.lit(f" {name} ago"))).otherwise(out)
    return out


def iso_utc(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


#: Numbers that are summed one by one in a running sum; beyond them whole stretches are.
STRETCH = 64


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is used; for what stands inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def sums_before(numbers: Column) -> Column:
    """For each number of an array, the sum of those before it. Stretches are summed first, so that the work for n numbers
    grows with n times STRETCH and with the square of n / STRETCH, and no array is copied for each number."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, n: a + n)

    def of(x: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STRETCH).cast("int")), lambda k: F.slice(x, k * STRETCH + 1, F.lit(STRETCH)))
        placed = lambda parts, starts: F.flatten(F.transform(parts, lambda own, k: F.transform(own, lambda _, i: F.get(starts, k) + total(F.slice(own, F.lit(1), i)))))
        starts = lambda sums: F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k)))
        return let(stretches, lambda parts: let(F.transform(parts, total), lambda sums: let(starts(sums), lambda begin: placed(parts, begin))))

    return let(numbers, lambda x: F.when(F.size(x) > 0, of(x)).otherwise(F.expr("cast(array() as array<bigint>)")))
