"""Path rules over POSIX paths as column expressions: cleaning folds the segments of a path in an array."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(path: Column) -> Column:
    """The shortest equal path: no ".", no empty segments, ".." folded; "." for nothing; a leading slash stays."""
    rooted = path.startswith("/")

    def step(done: Column, part: Column) -> Column:
        up = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return (
            F.when((part == "") | (part == "."), done)
            .when((part == "..") & up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when((part == "..") & rooted, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def _escapes(cleaned: Column) -> Column:
    return (cleaned == "..") | cleaned.startswith("../")


def output_path(name: Column) -> Column:
    """Where a package entry goes, below the package's root: leading slashes drop; null if it is unsafe."""
    trimmed = F.regexp_replace(name, "^/+", "")
    cleaned = clean(trimmed)
    ok = (name != "") & ~name.rlike(r"[\\\x00:]") & (trimmed != "") & (cleaned != ".") & ~_escapes(cleaned)
    return F.when(ok, cleaned)


def zip_entry_ok(name: Column) -> Column:
    """An archive entry must already be clean and relative."""
    cleaned = clean(name)
    return F.coalesce((name != "") & ~name.rlike(r"[\\\x00:]") & ~name.startswith("/") & (cleaned == name) & (cleaned != ".") & ~_escapes(cleaned), F.lit(False))


def fallback_path(name: Column) -> Column:
    """The fallback's stricter rule: backslashes count as slashes, any ".." segment is refused; null if so."""
    slashed = F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), "^/+", "")
    ok = (slashed != "") & ~F.array_contains(F.split(slashed, "/"), "..") & ~slashed.contains("\0")
    return F.when(ok, clean(slashed))


def page_base(page: Column) -> Column:
    """A page's base path below the source root; null if it is empty, absolute or escapes."""
    cleaned = clean(page)
    return F.when((page != "") & ~page.startswith("/") & ~_escapes(cleaned), cleaned)


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/+$", "")


def resolve(page: Column, reference: Column) -> Column:
    """A component reference seen from a page: from the root if it starts with a slash; null for URLs and escapes."""
    from_root = reference.startswith("/") | (page == "")
    joined = F.when(from_root, F.regexp_replace(reference, "^/", "")).otherwise(F.concat_ws("/", F.when(parent(page) != "", parent(page)), reference))
    cleaned = clean(joined)
    return F.when((reference != "") & ~reference.contains("://") & (cleaned != ".") & ~_escapes(cleaned), cleaned)


def change_extension(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(ext))


def relative(source: Column, target: Column) -> Column:
    """target as seen from source's folder."""
    a, b = F.filter(F.split(parent(source), "/"), lambda x: x != ""), F.split(target, "/")
    n = F.least(F.size(a), F.size(b) - 1)
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= n) | ~(F.get(a, i).eqNullSafe(F.get(b, i))))
    common = F.element_at(differ, 1)
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - common), F.slice(b, common + 1, F.size(b))), "/")


def walk_order(path: Column) -> Column:
    """Sort key of a directory walk: segments compare one by one, so a/x comes before a-b/x and a.js."""
    return F.split(path, "/")
