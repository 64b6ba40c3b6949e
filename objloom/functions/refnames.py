"""Reference names as column expressions.

A name's rules are a list of (pattern, what is wrong); the first pattern that
matches names the error.  Bytes are taken as characters, as all forbidden ones
are ASCII.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forbidden forms of a name.
RULES = [
    (r"\A@\z", "single @"),
    (r"\A\z|\A/|//|/\z", "empty component"),
    (r"\.\.", "double dot"),
    (r"@\{", "at brace"),
    (r"[\x00-\x20\x7f:?\[\\^~]", "forbidden character"),
    (r"(?:\A|/)\.", "leading dot"),
    (r"\.lock(?:/|\z)", "lock suffix"),
    (r"\.\z", "trailing dot"),
]
ROOTS = ("HEAD", "AUTO_MERGE", "BISECT_EXPECTED_REV", "NOTES_MERGE_PARTIAL", "NOTES_MERGE_REF", "MERGE_AUTOSTASH")
PSEUDO = ("FETCH_HEAD", "MERGE_HEAD")
PER_WORKTREE = ("refs/worktree/", "refs/bisect/", "refs/rewritten/")


def is_valid(name: Column, one_level: bool = False, pattern: bool = False) -> Column:
    bad = F.lit(False)
    for p, _ in RULES:
        bad = bad | name.rlike(p)
    stars = r"\*.*\*" if pattern else r"\*"
    bad = bad | name.rlike("(?s)" + stars)
    if not one_level:
        bad = bad | ~F.contains(name, F.lit("/"))
    return ~bad


def problem(name: Column, one_level: bool = False, pattern: bool = False) -> Column:
    """What is wrong with a name, by the list's order; null for a valid one."""
    rules = [*RULES, (r"(?s)\*.*\*" if pattern else r"\*", "asterisk")] + ([] if one_level else [(r"\A[^/]*\z", "one level")])
    out = F.when(name.rlike(rules[0][0]), rules[0][1])
    for p, what in rules[1:]:
        out = out.when(name.rlike(p), what)
    return out


def normalised(name: Column) -> Column:
    """Without leading and repeated slashes."""
    return F.regexp_replace(F.regexp_replace(name, "/+", "/"), r"\A/", "")


def branch(name: Column) -> Column:
    """The full name of a branch shorthand, null if it can't be one."""
    full = F.concat(F.lit("refs/heads/"), name)
    ok = ~name.startswith("-") & (name != "HEAD") & is_valid(full)
    return F.when(ok, F.when(name.startswith("refs/"), name).otherwise(full))


_FORBIDDEN = [re.compile(p.replace(r"\z", r"\Z"), re.S) for p, _ in RULES]


def valid_tag_name(name: bytes) -> bool:
    """Whether a tag object's name is a tag shorthand, for codecs."""
    full = "refs/tags/" + name.decode("latin-1")
    return name != b"HEAD" and not name.startswith(b"-") and "*" not in full and not any(p.search(full) for p in _FORBIDDEN)


def tag(name: Column) -> Column:
    full = F.concat(F.lit("refs/tags/"), name)
    return F.when(~name.startswith("-") & (name != "HEAD") & is_valid(full), full)


def is_pseudo(name: Column) -> Column:
    return name.isin(*PSEUDO)


def is_root_syntax(name: Column) -> Column:
    return name.rlike(r"\A[A-Z_-]*\z")


def is_root(name: Column) -> Column:
    return is_root_syntax(name) & ~is_pseudo(name) & (name.endswith("_HEAD") | name.isin(*ROOTS))


def is_safe(name: Column) -> Column:
    """A path under refs/ that is its own normal form, or capital letters and underscores."""
    return F.when(name.startswith("refs/"), name.rlike(r"\Arefs(?:/(?!\.\.?(?:/|\z))[^/]+)+\z")).otherwise(name.rlike(r"\A[A-Z_]+\z"))


def is_per_worktree(name: Column) -> Column:
    return name.startswith(PER_WORKTREE[0]) | name.startswith(PER_WORKTREE[1]) | name.startswith(PER_WORKTREE[2])


def _current(name: Column) -> Column:
    return is_root_syntax(name) | is_per_worktree(name)


def worktree(name: Column) -> Column:
    """struct(kind, worktree, bare)."""
    own, rest = F.regexp_extract(name, r"(?s)\Aworktrees/([^/]*)", 1), F.regexp_extract(name, r"(?s)\Aworktrees/[^/]*/(.*)\z", 1)
    main = F.regexp_extract(name, r"(?s)\Amain-worktree/(.*)\z", 1)
    row = lambda kind, tree, bare: F.struct(F.lit(kind).alias("kind"), tree.alias("worktree"), bare.alias("bare"))
    none = F.lit("")
    return (
        F.when(name.rlike(r"(?s)\Aworktrees/[^/]*\z"), row("other", own, none))
        .when(name.startswith("worktrees/") & _current(rest), row("other", own, rest))
        .when(name.startswith("main-worktree/") & _current(main), row("main", none, main))
        .when(_current(name), row("current", none, name))
        .otherwise(row("shared", none, name))
    )


def can_update(name: Column, has_value: Column) -> Column:
    return ~is_pseudo(name) & F.when(has_value, is_valid(name, one_level=True)).otherwise(is_safe(name))


def can_point_to(name: Column, target: Column) -> Column:
    """Whether a symbolic reference of that name may have that target."""
    head = worktree(name)["bare"] == "HEAD"
    return (~head | target.startswith("refs/heads/")) & (is_root(target) | is_valid(target) & (target.startswith("refs/") | target.startswith("worktrees/")))


def prefixes(name: Column) -> Column:
    """The proper path prefixes of a name: a/b/c has a and a/b."""
    parts = F.split(name, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


_BAD = {*map(chr, range(0x21)), "\x7f", *":?[\\^~*"}


def sanitised(component: str) -> str:
    """A component made valid, with the known quirks: ``@`` gives ``-/@``, and a trailing dot stays.

    Forbidden characters and a ``{`` after ``@`` become ``-``; of a run of dots
    the first stays; a part's leading dot becomes ``-``; ``.lock`` is cut off a
    part's end for as long as it has it.
    """
    out = "-" if component == "@" else ""
    parts = component.split("/")
    for n, part in enumerate(parts):
        if out:
            out += "/"
        if part == "":
            if n == len(parts) - 1:
                break
            continue
        made = "".join("-" if c in _BAD or c == "{" and i and part[i - 1] == "@" else c for i, c in enumerate(part))
        made = made[:1] + "".join(c for i, c in enumerate(made) if i and not (c == "." and part[i - 1] == "."))
        if made.startswith("."):
            made = "-" + made[1:]
        out += made
        if part.endswith(".lock"):
            while out.endswith(".lock"):
                out = out[:-5]
    return out
