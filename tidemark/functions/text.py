"""Text: addresses, sanitising, escaping, secrets, money and age, labels, alerts, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: What providers say, labels and places (fixed values).
ERRORS = {
    "history": r"archive|missing trie node|state (?:is )?(?:not available|unavailable)|pruned|older than|beyond the (?:last|available)|header not found",
    "range": r"block range|range too large|up to a \d+ block|query returned more than|limit exceeded",
    "rate": r"429|rate ?limit|too many requests|capacity|timeout|ETIMEDOUT|ECONNRESET",
}
UNKNOWN = "not measured"
COMPONENTS = {"liquidity": "Liquidity", "momentum": "Momentum", "holder": "Holder", "smartMoney": "Smart Money"}
TRIGGERS = {"LEVEL_UPGRADED": "upgraded", "SCORE_MOVED": "score moved", "COOLDOWN_ELAPSED": "still active"}
ICONS = {"CRITICAL": "\U0001f6d1", "HIGH": "⚠", "MEDIUM": "⚠", "LOW": "ℹ"}
LINKS = {"DexScreener": "https://dexscreener.com/base/", "GeckoTerminal": "https://www.geckoterminal.com/base/pools/"}


def canonical(address: Column) -> Column:
    """Lower case without outer white space; null unless 20 bytes of hex."""
    clean = F.lower(F.trim(address))
    return F.when(clean.rlike("^0x[0-9a-f]{40}$"), clean)


def shorten(address: Column, head: int = 6, tail: int = 4) -> Column:
    return F.when(F.length(address) <= head + tail, address).otherwise(F.concat(F.substring(address, 1, head), F.lit("…"), F.substring(address, -tail, tail)))


def sanitize(text: Column, most: int = 128) -> Column:
    """Without control characters and outer white space, cut to ``most`` characters; empty is null."""
    clean = F.trim(F.regexp_replace(text, "[\\x00-\\x1f\\x7f]", ""))
    return F.nullif(F.substring(clean, 1, most), F.lit(""))


def escape_html(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def redact(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Known secrets of eight characters and more and bot tokens are blotted out; of URLs with a path the host stays."""
    for secret in sorted({x.strip() for x in secrets}, key=len, reverse=True):
        if len(secret) >= 8:
            text = F.replace(text, F.lit(secret), F.lit("[REDACTED]"))
    text = F.regexp_replace(text, r"\bbot?\d{6,}:[A-Za-z0-9_-]{30,}\b", "[REDACTED]")
    return F.regexp_replace(text, r"(https?|wss?)://([^/\s\"']+)/[^\s\"']*", "$1://$2/[REDACTED]")


def redact_deep(value: Column, kind: DataType, secrets: tuple[str, ...] = (), depth: int = 0) -> Column:
    """``redact`` in every text within structs, arrays and map values, up to eight levels down; other types stay as they are."""
    if depth > 8:
        return value
    if isinstance(kind, StringType):
        return redact(value, secrets)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redact_deep(x, kind.elementType, secrets, depth + 1))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: redact_deep(x, kind.valueType, secrets, depth + 1))
    if isinstance(kind, StructType):
        fields = [redact_deep(value.getField(f.name), f.dataType, secrets, depth + 1).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def _tenths(x: Column) -> Column:
    """One decimal, none for whole numbers."""
    k = _half_up(x * 10)
    return F.when(k % 10 == 0, (k / 10).cast("long").cast("string")).otherwise(F.format_string("%.1f", k / 10))


def _three_digits(x: Column) -> Column:
    """Three significant digits; under a millionth with an exponent."""
    shown = F.split(F.format_string("%.2e", x), "e")
    power = F.when(x == 0, 0).otherwise(shown[1].cast("int"))
    plain = F.call_function("format_string", F.concat(F.lit("%."), (2 - power).cast("string"), F.lit("f")), x)
    return F.when(power < -6, F.concat(shown[0], F.lit("e"), power)).otherwise(plain)


def money(x: Column) -> Column:
    """Dollars with a letter for thousands, millions and billions and one decimal; under a dollar three digits count."""
    size = F.abs(x)
    sound = x.isNotNull() & ~F.isnan(x) & (size < float("inf"))
    shown = F.when(size >= 1e9, F.concat(_tenths(x / 1e9), F.lit("B"))).when(size >= 1e6, F.concat(_tenths(x / 1e6), F.lit("M"))).when(size >= 1e3, F.concat(_tenths(x / 1e3), F.lit("K"))).when(size >= 1, _tenths(x)).otherwise(_three_digits(x))
    return F.when(sound, F.concat(F.lit("$"), shown)).otherwise(UNKNOWN)


def age(minutes: Column) -> Column:
    """Whole minutes, from an hour on hours and the minutes beyond them."""
    sound = minutes.isNotNull() & ~F.isnan(minutes) & (minutes >= 0) & (minutes < float("inf"))
    m = F.floor(F.when(sound, minutes))
    hours, rest = F.floor(m / 60), m % 60
    return F.when(~sound, UNKNOWN).when(m < 60, F.concat(m, F.lit("m"))).when(rest == 0, F.concat(hours, F.lit("h"))).otherwise(F.concat(hours, F.lit("h "), rest, F.lit("m")))


def offset_label(seconds: Column) -> Column:
    """T0, whole hours, whole minutes, or seconds."""
    return F.when(seconds == 0, "T0").when(seconds % 3600 == 0, F.concat(F.floor(seconds / 3600), F.lit("h"))).when(seconds % 60 == 0, F.concat(F.floor(seconds / 60), F.lit("m"))).otherwise(F.concat(seconds, F.lit("s")))


def error_class(message: Column) -> Column:
    """history, range, rate, or transient, in this order."""
    found = F.lit("transient")
    for name, pattern in reversed(ERRORS.items()):
        found = F.when(F.coalesce(message, F.lit("")).rlike("(?i)" + pattern), name).otherwise(found)
    return found


def alert_level(state: Column) -> Column:
    return F.when(state == "STRONG_SIGNAL", "STRONG").when(state == "INTERESTING", "INTERESTING").otherwise("NONE")


def is_active(state: Column) -> Column:
    return state != "EXPIRED"


def _named(key: Column, names: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[key], other)


def render_alert(a: Column) -> Column:
    """The text of an alert.

    ``a`` is a struct of level, trigger, symbol, token, pool, age (minutes), market_cap, liquidity, score, coverage,
    components (array of name and raw), status, and flags (array of severity and message). What is unknown is said to be.
    """
    first = F.when(a["level"] == "STRONG", "\U0001f6a8 STRONG SIGNAL").otherwise("\U0001f440 INTERESTING")
    why = _named(a["trigger"], TRIGGERS, F.lit(""))
    of_100 = lambda x: F.concat(_half_up(x), F.lit("/100"))
    parts = F.transform(a["components"], lambda c: F.concat(F.lit("• "), _named(c["name"], COMPONENTS, c["name"]), F.lit(": "), F.coalesce(of_100(c["raw"]), F.lit(UNKNOWN))))
    partial = F.when(a["coverage"] < 1, F.array(F.concat(F.lit("• Evidence coverage: "), _half_up(a["coverage"] * 100), F.lit("%")))).otherwise(F.array().cast("array<string>"))
    calm = F.coalesce(F.concat(F.lit("• "), escape_html(a["status"]), F.lit(", no warnings")), F.lit("• not yet evaluated"))
    warned = F.transform(a["flags"], lambda f: F.concat(_named(f["severity"], ICONS, F.lit("⚠")), F.lit(" "), escape_html(f["message"])))
    links = [F.concat(F.lit(f'<a href="{place}'), a["pool"], F.lit(f'">{name}</a>')) for name, place in LINKS.items()]
    head = F.array(
        F.when(why == "", first).otherwise(F.concat(first, F.lit(" ("), why, F.lit(")"))),
        F.concat(F.lit("TOKEN: $"), F.when(F.coalesce(a["symbol"], F.lit("")) == "", "UNKNOWN").otherwise(escape_html(a["symbol"]))),
        F.concat(F.lit("CA: <code>"), escape_html(a["token"]), F.lit("</code>")),
        F.concat(F.lit("Age: "), age(a["age"])),
        F.concat(F.lit("MC: "), money(a["market_cap"])),
        F.concat(F.lit("Liquidity: "), money(a["liquidity"])),
        F.concat(F.lit("Score: "), of_100(a["score"])),
        F.lit(""),
        F.lit("Why:"),
    )
    risks = F.when(F.size(a["flags"]) > 0, warned).otherwise(F.array(calm))
    return F.array_join(F.concat(head, parts, partial, F.array(F.lit(""), F.lit("Risk:")), risks, F.array(F.lit(""), F.concat_ws(" | ", *links))), "\n")
