"""Column functions over paths and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanseek import fixed_values as fv


def parts(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def directory(path: Column) -> Column:
    """Everything before the last slash, with that slash; empty for a bare file name."""
    return F.regexp_extract(path, r"(?s)^(.*/)?[^/]*$", 1)


def parents(path: Column) -> Column:
    p = parts(path)
    return F.slice(p, F.lit(1), F.size(p) - 1)


def suffix(path: Column) -> Column:
    """Last extension, lower-cased; leading dots of a name start no extension."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^\.*[^.].*?(\.[^.]+)$", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, key)


def language(path: Column) -> Column:
    return _lookup(fv.LANGUAGE_BY_SUFFIX, suffix(path))


def card_language(path: Column) -> Column:
    return F.coalesce(_lookup(fv.CARD_LANGUAGE_BY_SUFFIX, suffix(path)), F.lit("text"))


def _ends_with_any(text: Column, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | F.endswith(text, F.lit(e))
    return out


def is_declaration_file(path: Column) -> Column:
    return _ends_with_any(file_name(path), fv.DECLARATION_ENDINGS)


def in_skipped_dir(path: Column, in_git: Column | bool = True) -> Column:
    """Exact, case-sensitive match of any parent; node_modules counts only outside a git checkout."""
    up = parents(path)
    always = F.arrays_overlap(up, F.array(*[F.lit(d) for d in fv.SKIPPED_DIRS]))
    walked = F.arrays_overlap(up, F.array(*[F.lit(d) for d in fv.SKIPPED_DIRS_OUTSIDE_GIT]))
    return F.when(F.lit(in_git) if isinstance(in_git, bool) else in_git, always).otherwise(walked)


def looks_minified(path: Column, content: Column) -> Column:
    """By name, or by one very long line in the first 4096 bytes."""
    head = F.substring(content, 1, fv.MINIFIED_HEAD_BYTES)
    # latin-1 maps every byte to one character, so lengths stay byte lengths
    lines = F.split(F.decode(head, "ISO-8859-1"), "\n")
    longest = F.array_max(F.transform(lines, F.length))
    return _ends_with_any(file_name(path), fv.BUNDLE_ENDINGS) | (
        (F.length(head) > fv.MINIFIED_MIN_HEAD) & (longest > fv.MINIFIED_LINE_BYTES))


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    dirs = F.array(*[F.lit(d) for d in fv.TEST_DIRS])
    return F.arrays_overlap(parents(low), dirs) | file_name(low).rlike("(?i)" + fv.TEST_FILE)


def github_owner_name(link: Column) -> Column:
    """struct(owner, name) of a repository link; null when it is not one."""
    from spanseek.functions.text import strip

    text = strip(link)
    owner = F.regexp_extract(text, fv.GITHUB_LINK, 1)
    name = F.regexp_extract(text, fv.GITHUB_LINK, 2)
    return F.when(text.rlike(fv.GITHUB_LINK), F.struct(owner.alias("owner"), name.alias("name")))


def permalink(label: Column, commit: Column, path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), label, F.lit("/blob/"), commit, F.lit("/"), path,
                    F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))
