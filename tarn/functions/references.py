"""The rules of scrub.py as column expressions: what is public in a text stays, a host path becomes a portable one or its last segment."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions import paths, scrub

_REFERENCE = "(?i)(?:" + "|".join(f"(?:{p})" for p in scrub.FORMS.values()) + ")"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row; null for null."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def _last(path: Column) -> Column:
    return F.regexp_extract(path, "(?s)([^/]*)$", 1)


def rooted(value: Column) -> Column:
    """What lies within the first known folder of scrub.PORTABLE, the innermost of its name; else the last step alone."""

    def public(whole: Column) -> Column:
        out = F.when(whole == "/", scrub.HIDDEN_PATH)
        for folder, label in scrub.PORTABLE:
            pattern = f"(?s)^.*/{'/'.join(folder)}/(.+)$"
            out = out.when(whole.rlike(pattern), F.concat(F.lit("".join(f"{x}/" for x in label)), F.regexp_extract(whole, pattern, 1)))
        return out.otherwise(_last(whole))

    return _let(paths.clean(F.concat(F.lit("/"), value)), public)


def path(value: Column) -> Column:
    """One reference, by its form."""
    drive = lambda c: F.substring(c, 2, 1) == ":"
    slashed = F.replace(value, F.lit("\\"), F.lit("/"))

    # what is at a root, with what is before the root cut off; null for other forms
    behind = F.regexp_extract(slashed, "(?s)^.*?://(.*)$", 1)
    url = value.contains("://")
    windows = ~url & (drive(value) | value.startswith("\\\\"))
    at_root = F.when(url, F.when(~behind.contains("://") & (behind.startswith("/") | drive(behind)), behind)).when(windows, slashed).when(value.startswith("/"), value)
    name = _last(F.regexp_replace(behind, "/+$", ""))
    other = F.when(url, F.when(name == "", scrub.HIDDEN_URL).otherwise(name)).otherwise(_let(paths.clean(value), lambda c: F.when(c.rlike(r"^\.\.(/|$)"), _last(c)).otherwise(c)))
    bare = F.when(url | windows, F.regexp_replace(at_root, "^[A-Za-z]:", "")).otherwise(at_root)
    public = url & value.rlike(rf"(?i)\A(?:{scrub.PUBLIC_URL})\z")
    return F.when((value == "") | public, value).when(at_root.isNotNull(), rooted(bare)).otherwise(other)


def text(value: Column) -> Column:
    """Every reference in a text; a text that starts at a root is one reference."""
    found = F.transform(F.regexp_extract_all(value, F.lit(_REFERENCE), F.lit(0)), path)
    between = F.split(value, _REFERENCE, -1)
    joined = F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(value.startswith("/"), path(value)).when(~value.rlike(_REFERENCE), value).otherwise(joined)


def relative_file(value: Column) -> Column:
    """Whether the name is that of a file inside a tree, written without detours."""
    return ~value.rlike(r"[\\\x00:]") & (value != "") & (value != ".") & ~value.startswith("/") & ~value.rlike(r"^\.\.(/|$)") & (paths.clean(value) == value)


def metric_allowed(name: Column, raw: Column, kind: Column) -> Column:
    """Whether a metric may be published: its name is known and its value of the name's kind. kind: s a string, n anything else but a list or an object."""
    whole = raw.rlike(r"\A[0-9]{1,18}\z") | (raw.rlike(r"\A[0-9]{1,15}\.0\z"))
    out = F.when(name.isin(*scrub.COUNT_METRICS), (kind == "n") & whole).when(name.isin(*scrub.FLAG_METRICS), (kind == "n") & raw.isin("true", "false"))
    for key, words in scrub.TEXT_METRICS.items():
        out = out.when(name == key, (kind == "s") & raw.isin(*words))
    return out.otherwise(F.lit(False))
