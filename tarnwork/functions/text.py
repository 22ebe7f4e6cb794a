"""Text functions as column expressions: normal forms, slugs, paths, names, estimates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.runtime import ship_active

WHITE = r"\s\u000B\u001C-\u001F\u0085\p{Z}"


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode composed form. Only texts with a character that can change leave the JVM."""
    ship_active()
    open_to_change = F.coalesce(text.rlike(r"[\u0300-\uFFFF\x{10000}-\x{10FFFF}]"), F.lit(False))
    return F.when(open_to_change, _composed(F.when(open_to_change, text))).otherwise(text)


def normalise_body(body: Column) -> Column:
    """Canonical form of a body for hashing: composed, LF, no trailing white space on lines, runs of blank lines
    as one, none at the edges. Null stays null."""
    lines = F.regexp_replace(F.regexp_replace(nfc(body), r"\r\n?", "\n"), rf"[{WHITE}&&[^\n]]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def content_hash(body: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(normalise_body(body), 256)


def chars4_tokens(text: Column) -> Column:
    """Tokens at four characters each, rounded down."""
    return F.floor(F.length(text) / 4)


def chars35_tokens(text: Column) -> Column:
    """Tokens at three and a half characters each, rounded up."""
    return F.ceil(F.length(text) / 3.5)


def to_posix(path: Column) -> Column:
    return F.coalesce(F.translate(path, "\\", "/"), F.lit(""))


def line_breaks(text: Column) -> Column:
    """All line and paragraph breaks as LF."""
    return F.regexp_replace(text, r"\r\n|[\r\u2028\u2029]", "\n")


def _words(name: Column, letters: str) -> Column:
    """The runs of `letters` in a name in lower case, joined by single hyphens."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(f"[{letters}]+"), F.lit(0)), "-")


def slugify(name: Column, cap: int = 64) -> Column:
    """A folder name: words of letters, digits, dots and underscores with hyphens between, no dot or hyphen at either
    end, device names avoided, at most `cap` long."""
    # Names that a file system may reserve for devices.
    devices = ["con", "prn", "aux", "nul", *(f"{port}{n}" for port in ("com", "lpt") for n in range(1, 10))]
    slug = F.btrim(_words(name, "a-z0-9._"), F.lit("-."))
    return F.when(slug.isin(devices), F.concat(slug, F.lit("-dir"))).otherwise(F.left(slug, F.lit(cap)))


def file_slug(name: Column) -> Column:
    """Slug of a file name without its extension; `file` when nothing is left."""
    slug = _words(F.regexp_replace(name, r"(?i)\.[a-z0-9]{1,5}$", ""), "a-z0-9")
    return F.when(slug == "", "file").otherwise(slug)


def is_local_path(path: Column) -> Column:
    """Whether a path is non-empty and names no other host."""
    return F.coalesce((path != "") & ~path.rlike(r"^[\\/]{2}[^\\/]"), F.lit(False))


def is_safe_segment(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~name.rlike(r"(^|[/\\])\.\.([/\\]|$)"), F.lit(False))


def repository_of(url: Column) -> Column:
    """`owner/name` of a remote URL of any shape, or the one segment, or `''`; credentials are dropped."""
    u = F.trim(F.coalesce(url, F.lit("")))
    path = F.when(u.rlike(r"^[A-Za-z0-9_.+-]+@[^:/]+:.+$"), F.regexp_extract(u, r"^[^:/]+:(.+)$", 1)).when(u.rlike(r"(?i)^[a-z][a-z0-9+.-]*://.+$"), F.regexp_replace(F.regexp_extract(u, r"(?i)^[a-z][a-z0-9+.-]*://(.+)$", 1), "^[^/]*/", "")).otherwise(to_posix(u))
    parts = F.filter(F.transform(F.split(F.regexp_replace(path, r"(?i)\.git$", ""), "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


# Places whose paths are never listed.
NOISE = [r"^[\\/]{2}[^\\/]", r"(?i)/Temp/claude/", r"(?i)/scratchpad/", r"(?i)/\.claude/projects/", "/node_modules/", r"/\.venv/", "/__pycache__/", r"/\.git/", "/dist/", "/build/", r"/\.next/"]


def is_noise_path(path: Column) -> Column:
    """Whether a path is machinery: empty, on another host, or below one of the `NOISE` places."""
    posix = to_posix(path)
    out = posix == ""
    for pattern in NOISE:
        out = out | posix.rlike(pattern)
    return out


def path_class(path: Column) -> Column:
    """`memory`, `plan`, `noise`, `docs` or `work`, in that order of precedence."""
    posix = to_posix(path)
    return F.when(posix.rlike(r"(?i)/\.claude/projects/[^/]+/memory/.+\.md$"), "memory").when(posix.rlike(r"(?i)/\.claude/plans/.+\.md$"), "plan").when(is_noise_path(path), "noise").when(posix.rlike("(^|/)docs/"), "docs").otherwise("work")


def is_scratchpad(cwd: Column) -> Column:
    return F.coalesce(F.lower(to_posix(cwd)).contains("/scratchpad"), F.lit(False))


def normal_path(path: Column) -> Column:
    """A path without empty and `.` segments, with forward slashes."""
    return F.array_join(F.filter(F.split(to_posix(path), "/"), lambda x: (x != "") & (x != ".")), "/")


def comparable(text: Column) -> Column:
    """Lower case, punctuation dropped, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def truncate(text: Column, limit: int) -> Column:
    """At most `limit` characters, the last one an ellipsis when cut."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def escape_inline(text: Column) -> Column:
    """Text that can't open a link, a table cell or a code span in markdown."""
    return F.regexp_replace(one_line(text), r"([\\`*_\[\]|<>])", r"\\$1")


# Types of conventional commits.
COMMIT_TYPES = ["feat", "fix", "docs", "test", "chore", "refactor", "perf", "ci", "build", "style", "revert"]


def conventional(subject: Column, body: Column) -> dict[str, Column]:
    """Type, scope and whether breaking, of a commit message; type and scope only for known types."""
    form = r"^(\w+)(\([^)]*\))?(!)?: "
    kind = F.lower(F.regexp_extract(subject, form, 1))
    known = subject.rlike(form) & kind.isin(COMMIT_TYPES)
    scope = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(subject, form, 2), r"[()]", "")), F.lit(""))
    footer = F.coalesce(body.rlike(r"(?m)^BREAKING[ -]CHANGE: "), F.lit(False))
    return {"commit_type": F.when(known, kind), "scope": F.when(known, scope), "breaking": footer | F.coalesce(known & (F.regexp_extract(subject, form, 3) == "!"), F.lit(False))}


def tokens_like(text: Column, pattern: str) -> Column:
    """Distinct whole tokens over `[A-Za-z0-9-]` that match `pattern`, in order of appearance."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9-]+"), F.lit(0)), lambda t: t.rlike(f"^(?:{pattern})$")))


def collection_for_course(course: Column) -> Column:
    """Collection of a course id such as `CS 101-A`: its letters and number in lower case, or `''`."""
    return F.lower(F.concat(F.regexp_extract(course, r"^\s*([A-Za-z]{2,6})[ _-]?(\d{2,4}[A-Za-z]?)", 1), F.regexp_extract(course, r"^\s*([A-Za-z]{2,6})[ _-]?(\d{2,4}[A-Za-z]?)", 2)))


def project_folder(cwd: Column) -> Column:
    """Folder name that a working directory is encoded to: everything but letters and digits as hyphens."""
    return F.regexp_replace(cwd, "[^A-Za-z0-9]", "-")


def note_name(session: Column, resume: Column, agent: Column) -> Column:
    """File name of a session's note, of its n-th resumption, or of one of its workers."""
    head = F.concat(F.lit("session-"), F.substring(F.regexp_replace(session, "[^A-Za-z0-9]", ""), 1, 8))
    tail = F.when(F.coalesce(resume, F.lit(1)) > 1, F.concat(F.lit("-r"), resume.cast("string"))).otherwise("")
    return F.concat(head, tail, F.when(agent.isNotNull() & (agent != ""), F.concat(F.lit("--"), F.regexp_replace(F.lower(agent), "^agent-", ""))).otherwise(""), F.lit(".md"))


def title_of(prompt: Column, words: int = 6, cap: int = 60) -> Column:
    """Title from a prompt: fenced and pasted text dropped, the first `words` words, at most `cap` characters."""
    plain = F.regexp_replace(F.coalesce(prompt, F.lit("")), r"(?s)```.*?(?:```|\z)|<pasted[^>]*>.*?(?:</pasted>|\z)", " ")
    kept = F.slice(F.filter(F.split(plain, r"\s+"), lambda w: w != ""), 1, words)
    return truncate(F.array_join(kept, " "), cap)


# Tags of machine-made parts of prompts.
NOISE_TAGS = ["system-reminder", "local-command-stdout", "local-command-caveat", "command-message"]


def normal_prompt(prompt: Column) -> Column:
    """A prompt without reminders and command noise; a command reads as its name and arguments."""
    out = F.coalesce(prompt, F.lit(""))
    for tag in NOISE_TAGS:
        out = F.regexp_replace(out, f"(?s)<{tag}>.*?</{tag}>", "")
    command = F.regexp_extract(out, r"(?s)<command-name>\s*(.*?)\s*</command-name>", 1)
    arguments = F.regexp_extract(out, r"(?s)<command-args>\s*(.*?)\s*</command-args>", 1)
    return F.trim(F.when(command != "", F.concat_ws(" ", command, F.nullif(arguments, F.lit("")))).otherwise(out))


def human_duration(millis: Column) -> Column:
    """`4h 12m`, `37m` or `unknown`."""
    minutes = F.round(millis / 60000).cast("bigint")
    return F.when(millis.isNull() | (millis < 0), "unknown").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))


def derive_phase(branch: Column, titles: Column, paths: Column) -> Column:
    """The phase a session belongs to: the one named by its branch, else by pull request titles (array), else by
    planning paths (array). A source naming exactly one decides; one naming several ends the search empty."""
    named = lambda text: F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\bphase[ _-]?(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("phase-"), F.regexp_replace(n, "^0+(?=.)", ""))))
    sources = [named(F.coalesce(branch, F.lit(""))), named(F.array_join(titles, "\n")), named(F.array_join(paths, "\n"))]
    out = F.lit("")
    for found in reversed(sources):
        out = F.when(F.size(found) == 1, F.element_at(found, 1)).when(F.size(found) > 1, "").otherwise(out)
    return out
