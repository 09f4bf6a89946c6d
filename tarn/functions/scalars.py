"""Scalar rules as column expressions: sizes, durations, ratios, file kinds, routes, markup attributes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes kept of a process's output; file classes by extension and by exact name.
OUTPUT_TAIL = 4 << 20
SCRIPT_EXTENSIONS = ("js", "wxs")
STYLE_EXTENSIONS = ("wxss", "css")
TEMPLATE_EXTENSIONS = ("wxml", "html")
TEXT_EXTENSIONS = ("js", "json", "wxml", "wxss", "wxs", "html", "css")
RUNTIME_FILES = ("app-service.js", "app-config.json", "page-frame.html", "page-frame.js", "app-wxss.js")
SOURCE_EXTENSIONS = ("html", "js", "json", "wxml", "wxss", "wxs")
PUBLIC_SOURCES = ("fallback", "generated", "inferred", "manifest", "native", "runtime")
PUBLIC_ENGINES = ("disabled", "fallback", "native", "parser", "safe-format", "static-verifier", "subpackage-guard")
EVENT_PREFIXES = ("capture-bind:", "capture-catch:", "mut-bind:", "bind:", "catch:")
BARE_EVENTS = (
    "animationend", "animationiteration", "animationstart", "blur", "change", "close", "columnchange", "complete", "confirm",
    "contact", "controltap", "ended", "error", "focus", "fullscreenchange", "getphonenumber", "getuserinfo", "input",
    "keyboardheightchange", "launchapp", "linechange", "load", "loadedmetadata", "longpress", "markertap", "message", "open",
    "opensetting", "pause", "pickend", "pickstart", "play", "progress", "ready", "regionchange", "reset", "scroll",
    "scrolltolower", "scrolltoupper", "seekcomplete", "submit", "tap", "timeupdate", "touchcancel", "touchend",
    "touchforcechange", "touchmove", "touchstart", "transitionend", "updated", "waiting",
)


def ratio(ok: Column, total: Column) -> Column:
    """Whole percent, cut and not rounded; 0 where there is nothing to divide by."""
    return F.when(total <= 0, 0).otherwise((ok.cast("double") / F.when(total > 0, total).cast("double") * 100).cast("int"))


def _one_decimal(x: Column) -> Column:
    tenths = F.floor(x * 10 + F.lit(0.5)).cast("long")
    return F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def bytes_text(n: Column) -> Column:
    """B below 1 KiB, then KB and MB with one decimal; empty for null and negative sizes."""
    return (
        F.when(n.isNull() | (n < 0), "")
        .when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(_one_decimal(n / 1024), F.lit(" KB")))
        .otherwise(F.concat(_one_decimal(n / (1024 * 1024)), F.lit(" MB")))
    )


def duration_text(ms: Column, units: tuple[str, str, str] = ("ms", "s", "min")) -> Column:
    """Milliseconds below a second; seconds, with a decimal below ten; then minutes and seconds, if any."""
    milli, second, minute = (F.lit(f" {u}") for u in units)
    minutes, seconds = F.floor(ms / 60_000).cast("string"), F.floor(F.pmod(ms, F.lit(60_000)) / 1000 + F.lit(0.5)).cast("long")
    return (
        F.when(ms.isNull(), "")
        .when(ms < 1000, F.concat(ms.cast("string"), milli))
        .when(ms < 10_000, F.concat(_one_decimal(ms / 1000), second))
        .when(ms < 60_000, F.concat(F.floor(ms / 1000 + F.lit(0.5)).cast("string"), second))
        .when(seconds > 0, F.concat(minutes, minute, F.lit(" "), seconds.cast("string"), second))
        .otherwise(F.concat(minutes, minute))
    )


def xml_escape(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def attribute_escape(s: Column) -> Column:
    """For a value in double quotes: single quotes stay."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def last_bytes(output: Column, n: int = OUTPUT_TAIL) -> Column:
    """The end of a process's output, n bytes of it; output is binary."""
    return F.substring(output, F.greatest(F.octet_length(output) - n + 1, F.lit(1)), F.lit(n))


def metric_number(metrics: Column, key: str) -> Column:
    """A number of a JSON map of metrics as a whole one, cut towards zero; null for what isn't a number."""
    found = F.try_variant_get(metrics, f"$.{key}", "variant")
    number = F.schema_of_variant(found).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    return F.when(number, F.try_variant_get(found, "$", "double").cast("long"))


def metric_text(metrics: Column, key: str) -> Column:
    """A string of a JSON map of metrics; empty for what isn't one."""
    found = F.try_variant_get(metrics, f"$.{key}", "variant")
    return F.coalesce(F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string")), F.lit(""))


def occurrences(s: Column, part: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("int")


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty if the last segment has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def file_kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*SCRIPT_EXTENSIONS), "script").when(ext.isin(*STYLE_EXTENSIONS), "style").when(ext.isin(*TEMPLATE_EXTENSIONS), "template").otherwise("asset")


def template_kind(path: Column) -> Column:
    return F.when(extension(path) == "wxml", "page").otherwise("file")


def script_kind(path: Column) -> Column:
    return F.when(path == "app.js", "app").when(path == "workers.js", "worker").when(path.endswith(".wxs"), "wxs").otherwise("page")


def source_tag(path: Column) -> Column:
    return F.when(path.isin(*RUNTIME_FILES), "runtime").otherwise("native")


def is_text_artifact(path: Column) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS)


def sniffed_type(content: Column, path: Column) -> Column:
    """The formatter's type of a file: by extension, else by how its content starts."""
    ext, head = extension(path), F.ltrim(content)
    return (
        F.when(ext.isin("js", "wxs"), "js").when(ext.isin("css", "wxss"), "css").when(ext.isin("html", "wxml"), "html").when(ext == "json", "json")
        .when(head.startswith("<"), "html").when(head.startswith("{") | head.startswith("["), "json").otherwise("js")
    )


def _head(content: Column) -> Column:
    """The first 512 bytes, each as one character; text counts in UTF-8."""
    return F.decode(F.substring(content.cast("binary"), 1, 512), "ISO-8859-1")


def likely_text(content: Column) -> Column:
    """No NUL in the first 512 bytes."""
    return ~_head(content).contains("\0")


def no_control_in_head(content: Column) -> Column:
    """No control character but tab, line feed and carriage return in the first 512 bytes."""
    return ~_head(content).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def no_control_anywhere(content: Column) -> Column:
    return ~content.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def normal_route(route: Column) -> Column:
    """Backslashes to slashes, outer space and leading slashes cut, one source extension dropped."""
    cleaned = F.regexp_replace(F.trim(F.replace(route, F.lit("\\"), F.lit("/"))), "^/+", "")
    return F.regexp_replace(cleaned, r"(?i)\.(html|wxml|js)$", "")


def valid_route(route: Column) -> Column:
    """A clean relative path without a source extension, query, fragment or outer space."""
    clean = route.rlike(r"^[^/]") & ~route.rlike(r"(^|/)(\.\.?)?(/|$)|[\\?#]|^\s|\s$")
    up = route.rlike(r"^(\.\./)*[^/]+") & ~route.startswith("../")
    return F.coalesce((route != "") & clean & up & ~extension(route).isin(*SOURCE_EXTENSIONS), F.lit(False))


def event_attribute(name: Column) -> Column:
    low = F.lower(name)
    prefixed = F.lit(False)
    for p in EVENT_PREFIXES:
        prefixed = prefixed | (low.startswith(p) & (F.length(low) > len(p)))
    return prefixed | F.regexp_extract(low, "^(?:bind|catch)(.+)$", 1).isin(*BARE_EVENTS)


def dynamic_handler(value: Column) -> Column:
    v = F.trim(value)
    return v.startswith("{{") & v.endswith("}}")


def suspicious_handler(value: Column) -> Column:
    v = F.trim(value)
    plain = v.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)?$")
    return (v == "") | (v == "Empty") | (~dynamic_handler(value) & ~plain)


def public_source(source: Column) -> Column:
    return F.when(source.isin(*PUBLIC_SOURCES), source).otherwise("other")


def public_engine(engine: Column) -> Column:
    return F.when(engine.isin(*PUBLIC_ENGINES), engine).otherwise("")


def stage_status(success: Column, partial: Column) -> Column:
    return F.when(partial, "partial").when(success, "success").otherwise("failed")


def nice_step(total: Column) -> Column:
    """Axis step of 1, 2, 5 or 10 times a power of ten for about six steps up to total."""
    rough = F.greatest(F.lit(1.0), total / 6)
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    part = rough / power
    nice = F.when(part <= 1, 1.0).when(part <= 2, 2.0).when(part <= 5, 5.0).otherwise(10.0)
    return F.when(total <= 0, 1).otherwise(F.greatest(F.lit(1.0), nice * power)).cast("long")
